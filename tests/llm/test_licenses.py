from __future__ import annotations

import re

from tests.llm.helpers import documents, edge_rows, frame
from tickloom.llm import licenses as op

PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in places}))


def test_counts_equal_brute_force(spark):
    rows = list(zip(documents().doc_id.tolist(), documents().text.tolist()))
    rows += [(5000, "MIT License; cc-by CC BY cc by. Apache\nlicense"), (5001, "the GNU, General Public-License!"), (5002, "xmit license mit licenses")]
    got = {r["id"]: r for r in op.summary(op.scan(frame(spark, rows))).collect()}
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1.0 if r["n_base"] else True)


def test_edits_are_found_with_their_spans(spark):
    text = "Intro. Licenced under the Apache  Licence, Version 2.0; and a GNU Generl Publik License here."
    spans = op.scan(frame(spark, [(1, text)])).first()["spans"]
    found = {(s["label"], text[s["start"]:s["end"]]): s["edits"] for s in spans}
    assert found[("apache", "Apache  Licence")] == 1
    assert found[("gpl", "GNU Generl Publik License")] == 2
    assert found[("apache", "Licenced under the Apache  Licence, Version 2.0")] == 2


def test_clean_texts_have_no_label(spark):
    rows = [(1, "a license to kill"), (2, "emit licensing data"), (3, "public notary"), (4, "mit lizenz")]
    assert {r["labels"] for r in op.summary(op.scan(frame(spark, rows))).collect()} == {""}


def test_pigeonhole_misses_no_match(spark):
    search = op.NoticeSearch(op.PHRASES, op.NOTICES)
    texts = ["mit licnse x", "the mlt license", "gnu genral publc licnse", "apache licens", "gnu general public licenses", "creativ comons attribution"]
    for text in texts:
        flat = f" {text} "
        direct = {n.label for n, p in zip(search.notices, search.patterns) if p.search(flat)}
        assert {s[0] for s in search(text)[2]} == direct and direct, text


def test_edges(spark):
    rows = edge_rows()
    got = op.summary(op.scan(frame(spark, rows))).collect()
    assert len(got) == len(rows) and {r["n_base"] for r in got} == {0}
    assert {r["n_words"] for r in got if r["id"] in (1, 2, 3)} == {0}
    assert op.summary(op.scan(frame(spark, []))).count() == 0


def test_an_edited_notice_beside_a_clean_one(spark):
    search = op.NoticeSearch(op.PHRASES, op.NOTICES)
    for text, label in (("apache licence apache license foo", "apache"), ("mozila publik license mozilla public license", "mpl"),
                        ("mit license mit licens mit lcense mit license", "mit")):
        spans = [(first, last, edits) for own, first, last, edits, _ in search(text)[2] if own == label]
        n = len(text.split()) // (3 if label == "mpl" else 2)
        assert len({s[:2] for s in spans}) == n, (text, spans)


def test_a_text_of_many_notices_takes_linear_time():
    import time

    search = op.NoticeSearch(op.PHRASES, op.NOTICES)
    text = "released under the mit licence by all " * 32_000
    start = time.perf_counter()
    n, places, spans = search(text)
    assert n == 7 * 32_000 and not places and len(spans) >= 32_000
    assert time.perf_counter() - start < 15
