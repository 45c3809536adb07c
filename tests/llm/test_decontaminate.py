from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from tests.llm.helpers import SF_DIR, documents, edge_rows, frame
from tickloom.llm import decontaminate as op

ITEMS = "item_id long, text string, id long, score double"


def items_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5) for r in rows], ITEMS)


def brute_scores(index, words):
    """Score of each item for a passage."""
    scores = [0.0] * len(index.ids)
    for t in {index.terms[w] for w in words if w in index.terms}:
        for block in range(index.block_start[t], index.block_start[t + 1]):
            for at in range(index.item_start[block], index.item_start[block + 1]):
                scores[index.item_of[at]] += index.item_score[at]
    return scores


def test_candidates_are_all_items_above_the_threshold():
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(3, 30)))) for i in range(70)]
    counts = [Counter(op.WORD.findall(t)) for _, t in items]
    frequency = Counter(t for c in counts for t in c)
    index = op.ItemIndex.build(items, frequency, len(items), sum(map(Counter.total, counts)) / len(items), block_items=4)
    passages = [draw.choices(vocabulary, k=draw.randint(1, 60)) for _ in range(80)] + [i[1].split() for i in items]
    pairs = sorted({(n, index.terms[w]) for n, p in enumerate(passages) for w in p if w in index.terms})
    passage, numbers = (np.array(x, np.int64) for x in zip(*pairs))
    for threshold in (0.3, 0.5, 0.9):
        got = {(p, i) for p, i, _ in index.candidates(numbers[:], passage, len(passages), 0.0 + threshold)}
        want = {(n, i) for n, p in enumerate(passages) for i, s in enumerate(brute_scores(index, p)) if s >= threshold - 1e-9}
        assert got == want


def brute(docs, items):
    """(document, item) where 0.8 of the question's and the answer's shingles occur in one stretch as long as a passage."""
    out = set()
    for i, text in docs:
        words = op.WORD.findall((text or "").casefold())
        have = Counter(tuple(words[k:k + n]) for n in range(1, 6) for k in range(len(words) - n + 1))
        for item, body in items:
            parts = [op.shingles(p, 5) for p in op.split_item(body or "")]
            if any(parts) and all(not p or sum(s in have for s in p) / len(p) >= 0.8 for p in parts):
                out.add((i, item))
    return out


def test_planted_items_are_found_wherever_they_stand(spark):
    base = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()
    items = [(r[0], r[1]) for r in base]
    docs = list(zip(documents().doc_id.tolist(), documents().text.tolist()))
    clean = [t for _, t in docs if len(t) > 3000][:4]
    planted = []
    for n, (item, text) in enumerate(items):
        words = clean[n % len(clean)].split(" ")
        at = (37 * n) % len(words)
        planted.append((5000 + item, " ".join(words[:at] + [text.upper()] + words[at:])))
    docs += planted
    found = op.contaminated(frame(spark, docs), items_frame(spark, items))
    got = {(r["id"], r["item_id"]) for r in found.collect()}
    assert {(5000 + item, item) for item, _ in items} <= got
    assert got == brute(docs, items)
    several = op.contaminated(frame(spark, docs), items_frame(spark, items), items_per_index=7)
    scores = {(r["id"], r["item_id"]): r["score"] for r in found.collect()}
    again = {(r["id"], r["item_id"]): r["score"] for r in several.collect()}
    assert again.keys() == scores.keys() and max(abs(again[k] - scores[k]) for k in again) < 1e-12
    kept = op.decontaminate(frame(spark, docs), items_frame(spark, items))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_half_an_item_is_not_a_leak(spark):
    text = "what is the name of the river that runs through the old town of the north? it is called the long winding water"
    docs = [(1, "so " + text), (2, text.split("?")[0]), (3, "it is called the long winding water"), (4, text.replace("river", "street"))]
    got = {r["id"] for r in op.contaminated(frame(spark, docs), items_frame(spark, [(7, text)])).collect()}
    assert got == {1}


def test_edges(spark):
    items = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "a b c"), (5, "a b c"), (None, "lorem ipsum dolor sit amet")]
    rows = edge_rows()
    got = op.contaminated(frame(spark, rows), items_frame(spark, items)).collect()
    assert {(r["id"], r["item_id"]) for r in got} == {(i, 4) for i in (4, 5, 13)} | {(i, 5) for i in (8, 9, None)} | {(6, None), (7, None)}
    kept = op.decontaminate(frame(spark, rows), items_frame(spark, items))
    assert kept.columns == frame(spark, rows).columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 10, 11, 12]
    assert op.contaminated(frame(spark, []), items_frame(spark, items)).count() == 0
    assert op.contaminated(frame(spark, rows), items_frame(spark, [])).count() == 0
    assert op.decontaminate(frame(spark, rows), items_frame(spark, [])).count() == len(rows)


def bm25(item, words, items):
    """Score of an item for a passage by the formula, over its score for itself."""
    bodies = [op.WORD.findall(t.casefold()) for _, t in items]
    mean = sum(map(len, bodies)) / len(bodies)

    def weight(term):
        n = sum(term in b for b in bodies)
        tf = item.count(term)
        return math.log(1 + (len(bodies) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(item) / mean))

    return sum(weight(t) for t in set(item) & set(words)) / sum(weight(t) for t in set(item))


def test_scores_are_bm25(spark):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(5, 25)))) for i in range(40)]
    docs = [(i, items[i][1] + " and more") for i in range(0, 40, 5)]
    for size in (50_000, 10):
        found = op.contaminated(frame(spark, docs), items_frame(spark, items), threshold=0.2, overlap=0.0, items_per_index=size).collect()
        want = {(d, i): bm25(t.split(), text.split(), items) for d, text in docs for i, t in items}
        assert {(r["id"], r["item_id"]) for r in found} == {k for k, v in want.items() if v >= 0.2}
        assert all(abs(r["score"] - want[r["id"], r["item_id"]]) < 1e-9 for r in found)
