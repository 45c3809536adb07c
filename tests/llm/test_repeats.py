from __future__ import annotations

import hashlib
import os
import random
import subprocess
import sys

import numpy as np
import pytest

from tests.llm.helpers import documents, edge_rows, frame
from tickloom.llm import repeats as op

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def brute(rows, length):
    """Bytes that stay, number of runs removed; in order of id, then text's place."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s:s + length]
            if window in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(window)
        out.append((bytes(b for b, g in zip(data, gone) if not g), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))))
    return out


def check(spark, rows, length=100, hot_rows=200_000):
    got = {r["id"]: r for r in op.remove_repeats(frame(spark, rows), length, hot_rows).collect()}
    for (i, text), (kept, runs) in zip(rows, brute(rows, length)):
        row, data = got[i], (text or "").encode()
        assert row["n_bytes"] == len(data)
        assert row["kept_sha256"] == hashlib.sha256(kept).hexdigest(), i
        assert len(row["spans"]) == runs and sum(s["end"] - s["start"] for s in row["spans"]) == len(data) - len(kept)


@pytest.mark.parametrize("hot_rows", [1, 5, 200_000])
def test_equals_brute_force(spark, hot_rows):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randint(1, 6)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(draw.randint(0, 40)))]
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passage)
            a = draw.randint(0, 60)
            parts += [p[a:a + draw.choice((90, 99, 100, 101, 150, 400))], " ".join(word() for _ in range(draw.randint(0, 30)))]
        rows.append((i, draw.choice((" ", "")).join(parts)))
    rows += [(100, rows[3][1]), (101, "z" * 350), (102, "ab" * 200), (103, "x" * 99), (104, None), (105, "")]
    check(spark, rows, hot_rows=hot_rows)


def test_documents(spark):
    found = documents().sort_values("doc_id")
    check(spark, list(zip(found.doc_id.tolist(), found.text.tolist())))


def test_edges(spark):
    rows = edge_rows()
    got = op.remove_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    copies = [r for r in got if r["id"] == 8]
    assert len(copies) == 2 and copies[0] == copies[1]
    twice = [(5, "q w e r t y " * 3 + "u" * 100), (5, "q w e r t y " * 3 + "u" * 100), (None, "u" * 100)]
    out = op.remove_repeats(frame(spark, twice)).collect()
    assert [r["kept"] for r in out if r["id"] == 5] == [None, None] and [bytes(r["kept"]) for r in out if r["id"] is None] == [b""]
    assert op.remove_repeats(frame(spark, [])).count() == 0


def test_every_window_has_one_sample_inside_it():
    draw = np.random.default_rng(2)
    for n in (0, 99, 100, 101, 5000):
        data = draw.integers(97, 100, n).astype(np.uint8)
        gram, first, last, place = op.samples(data, 100)
        windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)]) if len(first) else np.empty(0)
        assert windows.tolist() == list(range(max(0, n - 99)))
        assert (place >= last).all() and (place + op.GRAM <= first + 100).all()


def test_ids_of_any_type(spark):
    twice = "the same hundred bytes and more of them " * 5
    docs = spark.createDataFrame([("b", twice), ("a2", "x" + twice), (None, twice + "y"), ("a10", "one")], "doc_id string, text string").repartition(3)
    got = {r["id"]: sum(s["end"] - s["start"] for s in r["spans"]) for r in op.remove_repeats(docs).collect()}
    again = len(twice) - 40  # a period of forty bytes repeats inside the first text already
    assert got == {"a10": 0, "a2": again, "b": len(twice), None: len(twice)}


def test_runs_in_a_process_that_has_imported_nothing_else():
    """Workers of this process import what the operator names, and no other test's imports."""
    code = (
        "from pyspark.sql import SparkSession\n"
        "from tickloom.llm import repeats\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "twice = 'the same hundred bytes and more of them ' * 5\n"
        "docs = spark.createDataFrame([(1, twice), (2, twice), (3, None)], 'doc_id long, text string')\n"
        "print(sorted((r['id'], len(r['spans'])) for r in repeats.remove_repeats(docs).collect()))\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("[(1, 1), (2, 1), (3, 0)]"), done.stderr[-2000:]
