from __future__ import annotations

import re

import sentencepiece

import corpus_pipeline
from tests.llm.helpers import SF_DIR, components, documents, edge_rows, frame, simhash
from tests.llm.test_decontaminate import brute
from tickloom.llm import language, pieces


def expected(rows, items):
    """The pipeline's stages in plain Python, on rows of distinct ids."""
    rows = [(i, t) for i, t in rows if language.LETTERS.search(t or "")]
    first = {}
    for i, t in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    rows = sorted((i, t) for i, t in rows if i in set(first.values()))
    reached = components([simhash(t, 3) for _, t in rows], 2)
    rows = [r for n, r in enumerate(rows) if reached[n] == n]
    leaks = {i for i, _ in brute(rows, items)}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    return {i: library.encode(t) for i, t in rows if i not in leaks}


def test_run_equals_brute_force(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got == expected(list(zip(documents().doc_id.tolist(), documents().text.tolist())), items)


def test_stages_take_edges_and_empty_tables(spark):
    for rows in (edge_rows(), []):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
            out.count()
