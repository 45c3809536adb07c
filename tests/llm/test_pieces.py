from __future__ import annotations

import numpy as np
import sentencepiece

from tests.llm.helpers import documents, edge_rows, frame
from tickloom.llm import pieces as op

NASTY = [
    "", " ", "a  b   c\n\n\tx", "日本語のテキスト \U0001f600 ①", "\r\n x\r\r", "▁▁ ▁a▁", "a" * 50, "<0x0A> <s> </s> <unk>", "\x00\x01 a\x00b",
    "         x          y", "é" * 60, " " * 100, "(" * 30, "00000 1111 ====----====", "thethethethe", "ananananana bananas", "áé", "ﬁ ﬀ ㎏",
]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=op.default_model())


def test_ids_equal_the_library(spark):
    rows = list(enumerate(NASTY)) + [(1000 + i, t) for i, t in enumerate(documents().text.tolist())]
    got = {r["id"]: r for r in op.decode(op.encode(frame(spark, rows).repartition(3))).collect()}
    reference = library()
    for i, text in rows:
        assert got[i]["ids"] == reference.encode(text), repr(text[:60])
        assert got[i]["decoded"] == reference.decode(got[i]["ids"])
        assert got[i]["decoded"] == text.replace(op.SPACE, " ")


def test_suffix_array_finds_every_occurrence():
    draw = np.random.default_rng(6)
    codes = draw.integers(1, 4, 200)
    index = op.SuffixArray(codes, 5)
    patterns = draw.integers(1, 4, (60, 5))
    lengths = draw.integers(1, 6, 60)
    low, high = index.ranges(patterns, lengths)
    for p, n, a, b in zip(patterns, lengths, low, high):
        want = [i for i in range(200 - n + 1) if (codes[i:i + n] == p[:n]).all()]
        assert sorted(index.order[a:b].tolist()) == want


def test_forgetting_changes_nothing():
    model = op.PieceModel(open(op.default_model(), "rb").read())
    texts = documents().text.head(40).tolist()
    before = op._KEPT_CHUNKS, op._KEPT_PAIRS
    try:
        op._KEPT_CHUNKS, op._KEPT_PAIRS = 10, 50
        encoder = op.Encoder(model)
        got = [encoder([t])[0] for t in texts]
    finally:
        op._KEPT_CHUNKS, op._KEPT_PAIRS = before
    assert got == library().encode(texts)


def test_edges(spark):
    rows = edge_rows()
    got = op.decode(op.encode(frame(spark, rows))).collect()
    assert len(got) == len(rows) and all(r["decoded"] == (r["text"] or "") for r in got)
    assert [r["ids"] for r in got if r["id"] == 1] == [[]]
    assert op.decode(op.encode(frame(spark, []))).count() == 0


def test_pairs_side_by_side_equal_the_merges():
    """The backward reading of two merge trees against the merge procedure itself."""
    with open(op.default_model(), "rb") as file:
        model = op.PieceModel(file.read())
    assert model.in_turn[model.ids].mean() > 0.9
    draw = np.random.default_rng(5)
    short = model.ids[model.lengths <= 4]
    left, right = draw.choice(short, 20_000), draw.choice(short, 20_000)
    # Pairs that a merge crosses: the two sides of vocabulary strings.
    cut = [(model.rank[t[:k]][1], model.rank[t[k:]][1]) for t in list(model.rank)[:9000] for k in range(1, len(t)) if t[:k] in model.rank and t[k:] in model.rank]
    usable = set(model.ids.tolist())
    cut = np.array([p for p in cut if p[0] in usable and p[1] in usable])
    left, right = np.concatenate((left, cut[:, 0])), np.concatenate((right, cut[:, 1]))
    want = [model.merge(model.text(a) + model.text(b)) == [model.text(a), model.text(b)] for a, b in zip(left.tolist(), right.tolist())]
    assert model.side_by_side(left, right).tolist() == want and 0 < sum(want) < len(want)


def test_suffix_array_of_many_symbols_and_levels():
    """Fewer symbols fit in a number the more there are, so ranks are doubled more often; absent symbols match nothing."""
    draw = np.random.default_rng(8)
    codes = draw.choice(np.concatenate((np.full(30_000, 7), np.arange(1, 30_000))), 3000)
    codes[500:560] = codes[100:160]
    index = op.SuffixArray(codes, 12)
    assert len(index.levels) > 2
    starts, lengths = draw.integers(0, 2980, 300), draw.integers(1, 13, 300)
    patterns = codes[starts[:, None] + np.arange(12)]
    patterns[::5, 0] = 40_000
    low, high = index.ranges(patterns, lengths)
    for p, n, a, b in zip(patterns, lengths, low, high):
        want = [i for i in range(3000 - n + 1) if (codes[i:i + n] == p[:n]).all()]
        assert sorted(index.order[a:b].tolist()) == want


def test_decoding_in_blocks_of_any_size(monkeypatch):
    with open(op.default_model(), "rb") as file:
        decoder = op.Decoder(file.read())
    reference = library()
    lists = [reference.encode(t) for t in NASTY] + [[], [5, 200, 255]]
    want = [reference.decode(ids) for ids in lists[:-1]]
    array = op.pa.array([[1], *lists], op.pa.list_(op.pa.int32())).slice(1)
    whole = decoder(array)
    assert whole[:-1] == want
    for ids in (1, 3, 64):
        monkeypatch.setattr(op, "_DECODED_IDS", ids)
        assert decoder(array) == whole
