from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import difference, duck
from tickloom.llm import negatives as op
from tickloom.llm import queries
from tickloom.checks.registry import QUERIES

SCHEMA = "id long, label int, vector array<long>, key string, block string, part string, rank int, anchor string, windows int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", 1, "d", 2) for r in rows], SCHEMA)


def brute(rows, every, positives=5, negatives=10):
    rows = [r for r in rows if r[1] is not None and r[2]]
    place = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    out = []
    for i, (ident, label, x) in enumerate(rows):
        if ident is None or ident % every:
            continue
        scores = [int(np.dot(x, y)) for _, _, y in rows]
        order = sorted(range(len(rows)), key=lambda j: (-scores[j], place(j)))
        for p in [j for j in order if j != i and rows[j][1] == label][:positives]:
            fit = [j for j in order if rows[j][1] != label and 30 * scores[p] <= 100 * scores[j] <= 90 * scores[p]]
            out += [(ident, rows[p][0], r + 1, rows[j][0], scores[p], scores[j]) for r, j in enumerate(fit[:negatives])]
    return out


def check(spark, rows, every, **sizes):
    key = lambda r: tuple((v is None, v or 0) for v in r)
    got = [tuple(r) for r in op.mine(table(spark, rows), F.col("id") % every == 0, **sizes).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, every), key=key)
    return got


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 17, "anchor_rows": 3}, {"block_rows": 200, "anchor_rows": 1}])
def test_equals_brute_force(spark, sizes):
    draw = np.random.default_rng(1)
    rows = [(i, int(draw.integers(0, 4)), draw.integers(-40, 60, 8).tolist()) for i in range(400)]
    assert len(check(spark, rows, 20, **sizes)) > 100


def test_ties_and_copies(spark):
    draw = np.random.default_rng(2)
    few = [draw.integers(-3, 4, 4).tolist() for _ in range(6)]
    rows = [(i, int(draw.integers(0, 3)), few[int(draw.integers(0, 6))]) for i in range(150)]
    check(spark, rows, 10, block_rows=40)


def test_reading_stops_early():
    draw = np.random.default_rng(3)
    x = np.concatenate((draw.integers(0, 20, (5000, 2)), [[900, 900]] * 12))
    lists = op.SortedLists(np.arange(len(x)), np.arange(len(x)), np.zeros(len(x), int), x)
    rows, _, threshold = next(lists.read(np.array([3, 1])))
    assert len(rows) < 100 and threshold < 3600
    at, scores = lists.positives(5000, 0, np.array([3, 1]), 5)
    assert at.tolist() == [5001, 5002, 5003, 5004, 5005] and set(scores) == {3600}


def test_edge_rows(spark):
    rows = [
        (0, 1, [0, 0]), (1, 1, [5, 5]), (2, 2, [3, 3]), (3, None, [9, 9]), (4, 1, None), (5, 1, [None, 2]), (6, 1, []), (None, 2, [3, 3]), (None, 1, [5, 4]),
        (10, 1, [5, 5]), (10, 1, [5, 5]), (20, 3, [-4, 1]), (30, 2, [4, 3]), (31, 2, [4, 3]), (31, 2, [4, 3]), (40, 9, [1, 1]),
    ]
    clean = [r for r in rows if r[2] and None not in r[2]]
    got = [tuple(r) for r in op.mine(table(spark, rows), F.col("id") % 10 == 0, block_rows=4).collect()]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(brute(clean, 10), key=key)
    assert op.mine(table(spark, []), F.col("id") == 0).count() == 0
    assert op.mine(table(spark, rows), F.lit(None).cast("boolean")).count() == 0


def test_scores_that_do_not_fit_raise(spark):
    with pytest.raises(Exception, match="may not fit a long"):
        op.mine(table(spark, [(0, 1, [2**40]), (1, 1, [2**40])]), F.col("id") == 0).count()


def test_query_equals_sql_on_more_rows(spark):
    con = duck("/root/testdata/sf0.1")
    assert difference(queries.op13_hard_negatives(spark, "/root/testdata/sf0.1"), con, QUERIES["op13_hard_negatives"].sql) == ""
