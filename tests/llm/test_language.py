from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from tests.llm.helpers import edge_rows, frame
from tickloom.llm import language as op
from tickloom.llm.shared import small_batches


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [i for (i,) in docs.select("doc_id").collect() if zlib.crc32(str(i).encode()) % 5 == 0]
    from pyspark.sql import functions as F

    is_held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = op.fit(docs.where(~is_held))
    found = op.identify(docs.where(is_held), model).join(docs.selectExpr("doc_id AS id", "lang"), "id").toPandas()
    assert len(found) == len(held)
    right = pd.Series(found.language == found.lang)[found.language != op.UNKNOWN]
    assert right.mean() > 0.97 and found.score.between(0, 1).all()


def toy(spark):
    english, german = "the cat and the dog with this house ", "der hund und die katze mit dem haus "
    rows = [(i, english * 5, "en") for i in range(5)] + [(i + 10, german * 5, "de") for i in range(5)] + [(20, "кот и пес " * 9, "ru")]
    return frame(spark, rows)


def test_mixed_text_gets_spans(spark):
    model = op.fit(toy(spark))
    assert model.languages == ["de", "en", "ru"]
    text = "The cat and the dog, with this house. " * 2 + "Der Hund und die Katze mit dem Haus. " * 3 + "кот и пес!"
    row = op.identify(frame(spark, [(1, text)]), model).first()
    assert row["language"] == "de"
    spans = [(s["language"], text[s["start"]:s["end"]]) for s in row["spans"]]
    assert [s[0] for s in spans] == ["en", "de", "ru"]
    assert spans[1][1].startswith("Der Hund") and spans[1][1].endswith("Haus") and spans[2][1] == "кот и пес"
    assert 0.5 < row["score"] < 1


def test_viterbi_equals_trying_all_paths():
    draw = np.random.default_rng(4)
    scores = draw.normal(size=(6, 3)).astype(np.float32)
    lengths = np.array([6, 4, 4, 1])
    rows = draw.integers(0, 6, lengths.sum())
    got, at = op.viterbi(rows, lengths, scores, 0.7), 0
    for n in lengths:
        own = scores[rows[at:at + n]].astype(float)
        value = lambda p: sum(own[i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert np.isclose(value(got[at:at + n]), max(map(value, itertools.product(range(3), repeat=int(n)))))
        at += n


def test_edges(spark):
    model = op.fit(toy(spark))
    rows = edge_rows()
    got = op.identify(frame(spark, rows), model).collect()
    assert len(got) == len(rows)
    assert {(r["language"], r["score"]) for r in got if r["id"] in (1, 2, 3, 11)} == {("und", 0.0)}
    assert all(r["language"] in model.languages for r in got if r["id"] not in (1, 2, 3, 11))
    nothing = op.fit(frame(spark, [(1, "text", None), (2, None, "en")]))
    assert {r["language"] for r in op.identify(frame(spark, rows), nothing).collect()} == {"und"}
    assert op.identify(frame(spark, []), model).count() == 0
    kept = op.with_language(frame(spark, rows), model)
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(rows) - 4


def test_numerals_are_no_letters(spark):
    model = op.LanguageModel.of_counts([("en", "water", 5), ("en", "x", 1), ("de", "wasser", 5)])
    rows = [(1, "½ ² ④ Ⅷ"), (2, "x²"), (3, "wasser ½wasser"), (4, "一二")]
    got = {r["id"]: r for r in op.identify(frame(spark, rows), model).collect()}
    assert got[1]["language"] == "und" and got[1]["score"] == 0 and got[1]["spans"] == []
    assert got[2]["language"] == "en" and [(s["start"], s["end"]) for s in got[2]["spans"]] == [(0, 1)]
    assert got[3]["language"] == "de" and [(s["start"], s["end"]) for s in got[3]["spans"]] == [(0, 14)]
    assert got[4]["language"] != "und"
    kept = op.with_language(frame(spark, rows), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]


def test_only_texts_go_to_python(spark):
    """Whole rows neither go there nor come back."""
    docs = toy(spark)
    kept = op.with_language(docs, op.fit(docs))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    steps = [x for x in plan.splitlines() if "ArrowEvalPython" in x]
    assert "MapInArrow" not in plan and len(steps) == 1 and "(text#" in steps[0]
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_two_hundred_languages():
    names = [f"l{i:03d}" for i in range(200)]
    model = op.LanguageModel.of_counts([(n, f"word{chr(97 + i // 26)}{chr(97 + i % 26)}", 3) for i, n in enumerate(names)])
    known = op._WordRows(model)
    for i in (0, 127, 128, 199):
        word = f"word{chr(97 + i // 26)}{chr(97 + i % 26)}"
        assert op._label([f"{word} {word} {word}"], known, 8.0)[0][0] == names[i]


def test_words_scored_together_have_the_scores_of_each_alone():
    counts = [("de", "straße", 4), ("de", "haus", 3), ("en", "house", 5), ("en", "street", 2), ("ru", "улица", 6), ("ru", "дом", 2)]
    model = op.LanguageModel.of_counts(counts)
    words = ["haus", "häuser", "streets", "qqq", "улицы", "дом", "κόσμος", "x", "a" * 5000, "housex"]
    together = model.scores(words)
    for word, own in zip(words, together):
        known = [model.trigrams[g] for g in op._trigrams(word) if g in model.trigrams]
        allowed = model.scripts.get(op.script_of(word))
        if word in model.words:
            want = model.word_scores[model.words[word]]
        else:
            want = op._shares(model.trigram_scores[known].sum(axis=0)) if known else np.full(3, -np.log(3))
        want = np.full(3, -np.log(3)) if allowed is None else np.where(allowed, want, op._OUTSIDE)
        np.testing.assert_allclose(own, want, atol=1e-12)
    rows = op._WordRows(model)
    rows.learn(words, at_once=3)
    assert list(rows) == words and rows.lengths[:10].tolist() == list(map(len, words))
    np.testing.assert_allclose(rows.scores[:10], together, atol=1e-6)


def test_a_task_remembers_a_bounded_number_of_words(monkeypatch):
    """However many texts stand in one batch, and with the same answers."""
    model = op.LanguageModel.of_counts([("en", "water", 5), ("de", "wasser", 5)])
    texts = pa.array([" ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + k)}" for k in range(20)) for i in range(400)] + ["1 2", None, "water"])
    want = [True] * 400 + [False, False, True]
    assert next(op._has_language([texts], model, 8.0)).to_pylist() == want
    most, learn, pieces = [], op._WordRows.learn, op._pieces
    monkeypatch.setattr(op._WordRows, "learn", lambda self, words: (learn(self, words), most.append(len(self))))
    monkeypatch.setattr(op, "_pieces", lambda column: pieces(column, 1000))
    monkeypatch.setattr(op, "_KEPT_WORDS", 300)
    assert next(op._has_language([texts], model, 8.0)).to_pylist() == want
    assert len(most) > 10 and max(most) <= 300 + 1000 // 5


def test_texts_go_to_python_in_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.newSession()
    for given, want in (("64m", 4 << 20), ("100k", 100 << 10)):
        own.conf.set(setting, given)
        small_batches(own)
        assert own.conf.get(setting) in (f"{want}b", str(want), given) and (own.conf.get(setting) == given) == (given == "100k")
    docs = toy(spark)
    spark.conf.unset(setting)
    op.with_language(docs, op.fit(docs)).count()
    assert spark.conf.get(setting).rstrip("b") == str(4 << 20)
