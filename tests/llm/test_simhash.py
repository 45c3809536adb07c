from __future__ import annotations

import random

import pytest

from tests.llm.helpers import components, documents, edge_rows, frame, simhash
from tickloom.llm import simhash as op
from tickloom.llm.components import connected_components


def as_long(value):
    return value - (1 << 64) if value >= 1 << 63 else value


@pytest.mark.parametrize("size", [1, 3, 5])
def test_fingerprint_is_the_majority_of_each_bit(size):
    for text in [None, "", "One", "one TWO", "one two three four one two three", "É é A b"] + documents().text.head(20).tolist():
        assert op.fingerprint(text, size) % (1 << 64) == simhash(text, size)


@pytest.mark.parametrize("bits", [1, 2])
def test_links_are_all_close_pairs_once(spark, bits):
    draw = random.Random(3)
    values = {draw.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:
        for n in (1, 2, 3):
            near = v
            for b in draw.sample(range(64), n):
                near ^= 1 << b
            values.add(near)
    # Many in one list: the same six bytes, so that neighbours are looked up.
    values |= {0xABCDEF012345 << 16 | draw.getrandbits(16) for _ in range(300)}
    got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in op.links(
        spark.createDataFrame([(as_long(v),) for v in values], "fingerprint long"), bits).collect()]
    wanted = {frozenset((a, b)) for a in values for b in values if a < b and (a ^ b).bit_count() <= bits}
    assert len(got) == len(wanted) and {frozenset(p) for p in got} == wanted


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(900, 1000)] + [(7, 7), (70, 71), (70, 71)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 900 for i in range(900, 1001)} | {70: 70, 71: 70}


def test_near_copies_equal_brute_force(spark):
    found = documents().head(150)
    rows = list(zip(found.doc_id.tolist(), found.text.tolist()))
    rows += [(10_000 + i, t + " x") for i, t in rows[:30]]
    want_print = [simhash(t, 3) for _, t in rows]
    want = [rows[c][0] for c in components(want_print, 2)]
    got = {r["id"]: (r["fingerprint"] % (1 << 64), r["component_id"]) for r in op.near_copies(frame(spark, rows)).collect()}
    assert got == {i: (p, c) for (i, _), p, c in zip(rows, want_print, want)}


def test_edges_and_empty_table(spark):
    rows = edge_rows()
    got = op.near_copies(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["id"]: r for r in got}
    assert {by_id[i]["component_id"] for i in (1, 2, 3)} == {1} and by_id[1]["fingerprint"] == 0
    assert by_id[4]["component_id"] == by_id[13]["component_id"] == 4
    assert by_id[None]["component_id"] == 8
    kept = op.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    kept = [r["doc_id"] for r in kept.collect()]
    assert kept.count(8) == 1 and None not in kept and 2 not in kept
    assert op.near_copies(frame(spark, [])).count() == 0 and op.one_of_each(frame(spark, [])).count() == 0
