from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import queries, whitening
from tickloom.llm.queries import whitening_rows

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, whitened int, component string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", 3, "c", "d") for i, v in rows], SCHEMA)


def quantised(spark, rows):
    whole = F.transform("vector", lambda c: F.floor(64 * c.cast("double")) + 1000000)
    return whitening.vectors_of(table(spark, rows)).withColumn("vector", whole)


@pytest.mark.parametrize("spectrum", [
    np.arange(1.0, 13.0), np.r_[np.ones(6), 5.0], np.r_[1e6, np.full(8, 1.0), 1e-6], np.zeros(5), np.r_[1.0, 2.0, 3.0], np.array([7.0]),
    np.geomspace(1e-9, 1, 40), np.r_[np.zeros(4), 1.0, 2.0],
])
def test_components_are_eigenvectors(spectrum):
    n = len(spectrum)
    basis, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((n, n)))
    a = basis @ np.diag(spectrum) @ basis.T
    a = (a + a.T) / 2
    values, vectors = whitening.components(a)
    size = np.linalg.norm(a)
    assert np.abs(values - np.sort(spectrum)[::-1]).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size


def test_a_diagonal_and_a_constant_diagonal():
    values, vectors = whitening.components(np.diag([3.0, 9.0, 1.0]))
    assert values.tolist() == [9, 3, 1] and np.abs(vectors).sum() == 3
    values, _ = whitening.components(np.array([[2.0, 1.0], [1.0, 2.0]]))
    assert np.abs(values - [3, 1]).max() < 1e-14


def test_equals_a_dense_eigensolver(spark):
    draw = np.random.default_rng(8)
    x = (draw.standard_normal((300, 6)) @ draw.standard_normal((6, 6))).astype(np.float32)
    got = whitening_rows(quantised(spark, [(i, v.tolist()) for i, v in enumerate(x)]).repartition(7), count=4).toPandas()
    whole = np.floor(64 * x.astype(float)).astype(np.int64) + 1000000
    n, sums = len(whole), whole.sum(axis=0)
    centred = (n * whole - sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == 1200 and set(got.n) == {300} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    deviation = ((n * whole - sums) ** 2).sum(axis=1)
    for k in range(4):
        own = got[got.component == k + 1].sort_values("vec_id")
        want = centred @ v[:, k] / np.sqrt(e[k])
        want *= np.sign((want * own.whitened.to_numpy()).sum())
        assert np.abs(own.whitened.to_numpy() - want).max() < 1e-9
        assert (own.deviation.to_numpy() == deviation).all()
        assert np.abs(own.explained / (e[k] / e.sum()) - 1).max() < 1e-9


def test_unusable_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, []), (None, [2.0, 0.0]), (7, [3.0, 5.0]), (7, [3.0, 5.0])]
    got = whitening_rows(quantised(spark, rows), count=32).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (7, 1), (7, 1), (7, 2), (7, 2)]
    assert {r["n"] for r in got} == {4} and max(r["identity_error"] for r in got) < 1e-9


def test_rows_without_extent(spark):
    got = whitening_rows(quantised(spark, [(1, [1.0, 2.0])] * 3), count=32).collect()
    assert len(got) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in got)
    line = whitening_rows(quantised(spark, [(i, [float(i), 2.0]) for i in range(5)]), count=32).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and line[0]["identity_error"] < 1e-9


def test_empty_tables_and_lengths(spark):
    assert whitening_rows(quantised(spark, []), count=32).count() == 0
    assert whitening.fit(quantised(spark, [(1, None)])) is None
    with pytest.raises(Exception, match="entries in one table|entries"):
        whitening.fit(quantised(spark, [(1, [1.0]), (2, [1.0, 2.0])]).coalesce(1))


def test_doubles_as_they_are(spark):
    x = np.random.default_rng(2).standard_normal((50, 3)) + 100
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    vectors = whitening.vectors_of(vectors)
    model = whitening.fit(vectors)
    assert np.abs(model.eigenvalues - np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]).max() < 1e-11
    assert whitening.identity_error(whitening.whiten(vectors, model, 3)) < 1e-9


def test_the_whole_table(spark):
    got = queries.op11_embedding_whitening(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == 500 * 32 and got.identity_error.max() < 1e-4
    shares = got.groupby("component").explained.first()
    assert (shares.diff().dropna() <= 0).all()
