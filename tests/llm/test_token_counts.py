from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece

from tests.llm.helpers import documents, edge_rows, frame
from tickloom.llm import queries
from tickloom.llm import token_counts as op

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def shortcut():
    with open(PATH, "rb") as file:
        return op.Shortcut.prove(file.read())


ODD = [
    "", " ", "  ", "   ", "a", "a ", " a", "a  b", "  a   b  ", "\n", " \n ", "a\n\nb", "\t x", "<s> </s> <unk> <0x0A>", "▁", "▁▁a", "a▁b ▁ c",
    "日本語 テキスト", "\U0001f600 \U0001f600x", "é́ é", "\x00 a\x00", "http://a.b/c?d=e&f=%20", "x" * 500, "　 \xa0  ", "12345 67890.12",
]


def test_counts_equal_the_library(library, shortcut):
    counter = op.Counter(shortcut)
    draw = random.Random(4)
    letters = "aeinst AB\n  .,-é日▁0"
    mixed = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    for texts in (ODD, mixed, [t for t in documents().text if t]):
        assert counter(texts) == [len(x) for x in library.encode(texts)]


def test_proven_strings_are_one_token(library, shortcut):
    whole = sorted(shortcut.whole)
    assert len(whole) > 10_000
    assert all(len(x) == 1 for x in library.encode([op._text_of(p) for p in whole if p != op.SPACE]))


def test_long_texts_in_segments_and_forgetting(library, shortcut, monkeypatch):
    monkeypatch.setattr(op, "_SEGMENT", 50)
    monkeypatch.setattr(op, "_KEPT", len(shortcut.whole) + 20)
    counter = op.Counter(shortcut)
    draw = random.Random(6)
    texts = [" ".join("".join(draw.choice("abcdefg") for _ in range(draw.randint(0, 9))) for _ in range(n)) for n in (1, 5, 500, 3, 2000)]
    texts += ["x" * 5000, " " * 700, "ab " * 400]
    assert counter(texts) == [len(x) for x in library.encode(texts)]


def test_models_that_cannot_be_cut(monkeypatch, shortcut):
    class Joined(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "of▁the" if i == 400 else super().id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Joined)
    with pytest.raises(ValueError, match="behind a space"):
        op.Shortcut.prove(shortcut.model)


def test_edge_rows(spark, library):
    rows = edge_rows()
    got = sorted((r["id"] or 0, r["n_bytes"], r["n_tokens"]) for r in op.count_tokens(frame(spark, rows)).collect())
    assert got == sorted((r[0] or 0, len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows)
    assert op.count_tokens(frame(spark, [])).count() == 0


def test_the_whole_table(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = documents()
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text):
        n = len(library.encode(text or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 4096)
