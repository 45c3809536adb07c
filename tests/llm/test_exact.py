from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, edge_rows, frame
from tickloom.llm import exact as op


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    keep = {c: min(ids, key=lambda i: (i is None, i or 0)) for c, ids in groups.items()}
    return sorted(((i is None, i or 0), keep[c], len(ids)) for c, ids in groups.items() for i in ids)


def rows_of(df):
    return sorted(((r["id"] is None, r["id"] or 0), r["keep_id"], r["group_size"]) for r in df.collect())


@pytest.mark.parametrize("digest", [op.sha256, lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 2))])
@pytest.mark.parametrize("files", [None, 1])
def test_equals_brute_force(spark, digest, files):
    """Also with a digest of one byte, which different texts share, and over several micro-batches."""
    found = documents()
    rows = list(zip(found.doc_id.tolist(), found.text.tolist()))
    rows += [(1000 + i, f"  {t}\t ".replace(" ", "\n ")) for i, t in rows[:40]] + [(2000 + i, t) for i, t in rows[20:60]]
    df = frame(spark, rows).repartition(6)
    found = op.exact_copies(df, digest=digest, files_per_batch=files)
    assert rows_of(found) == brute(rows)
    assert {r["id"] for r in found.where("kept").collect()} == {k for _, k, _ in brute(rows)}


def test_edges(spark):
    rows = [r[:2] for r in edge_rows()]
    found = op.exact_copies(frame(spark, rows))
    assert rows_of(found) == brute(rows)
    assert found.where("kept").count() == len({k for _, k, _ in brute(rows)})
    assert op.exact_copies(frame(spark, [])).count() == 0
    kept = op.without_copies(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.where("doc_id = 8").count() == 1 and kept.where("doc_id IS NULL").count() == 0
