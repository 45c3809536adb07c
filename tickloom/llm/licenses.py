"""Fuzzy search for short license notices.

A notice that occurs with at most ``k`` edits, cut in ``k + 1`` pieces, has one piece unchanged
(pigeonhole). An automaton finds all pieces of all notices in one pass over the text's
normalised words; around each find the notice is matched with bounded errors by the
regex library, which counts the edits and gives the span. Matches begin and end at
words.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters; the
normalised text is its words with one space between.

Defined cases: null texts are empty and match nothing; overlapping places count each;
repeated rows are searched each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


#: Windows whose best match is remembered; forgetting costs time alone.
_KEPT_WINDOWS = 50_000


@dataclass(frozen=True)
class Notice:
    """A phrase of normalised words, and how many edits (characters) it may have."""

    label: str
    phrase: str
    edits: int


#: The phrases that are counted word by word; they may also occur with edits.
PHRASES = (
    Notice("gpl", "gnu general public license", 3),
    Notice("apache", "apache license", 1),
    Notice("cc-by", "cc by", 0),
    Notice("mit", "mit license", 1),
)
#: Further notices.
NOTICES = (
    Notice("agpl", "gnu affero general public license", 3),
    Notice("apache", "licensed under the apache license version 2 0", 6),
    Notice("artistic", "the artistic license", 2),
    Notice("bsd", "redistribution and use in source and binary forms", 6),
    Notice("bsd", "neither the name of the copyright holder nor the names of its contributors", 7),
    Notice("bsl", "boost software license", 2),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("cc0", "cc0 1 0 universal", 0),
    Notice("epl", "eclipse public license", 2),
    Notice("gpl", "licensed under the gnu general public license version", 6),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 7),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person", 7),
    Notice("mit", "released under the mit license", 4),
    Notice("mpl", "mozilla public license", 3),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 7),
    Notice("zlib", "this software is provided as is without any express or implied warranty", 7),
)


class NoticeSearch:
    """Automaton of the pieces and one bounded-error pattern for each notice."""

    def __init__(self, phrases: tuple[Notice, ...], notices: tuple[Notice, ...]) -> None:
        self.phrases, self.notices = len(phrases), (*phrases, *notices)
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(self.notices):
            exact = notice.edits == 0
            text = f" {notice.phrase} " if exact else notice.phrase
            cuts = [len(text) * i // (notice.edits + 1) for i in range(notice.edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((n, a - exact))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.seen: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        self.patterns = [
            regex.compile(rf"(?b)(?<= )(?:{regex.escape(x.phrase, special_only=True)}){{e<={x.edits}}}(?= )") for x in self.notices
        ]

    def __call__(self, text: str) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, int, float]]]:
        """Words of the text; (start word, phrase) of each unchanged phrase; (label, first word, last word, edits, share unchanged)."""
        words = text.encode().lower().translate(_TO_SPACE).split()
        flat = f" {b' '.join(words).decode()} "
        near: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(flat):
            for n, offset in places:
                near.setdefault(n, set()).add(end + 1 - size - offset)
        exact, found = set(), {}
        for n, starts in near.items():
            notice = self.notices[n]
            size, slack = len(notice.phrase), notice.edits + 1
            if n < self.phrases:
                exact |= {(s, n) for s in starts if s > 0 and flat.startswith(f" {notice.phrase} ", s - 1)}
            # Each expected place has a window of its own, which no other whole occurrence fits in.
            matches = set()
            for start in starts:
                low = max(start - slack - 1, 0)
                match = self._best(n, flat[low:start + size + slack + 1])
                if match:
                    matches.add((match[0], low + match[1], low + match[2]))
            for edits, s, e in _apart(matches):
                key = (notice.label, s, e)
                found[key] = min(found.get(key, (edits, size)), (edits, size))
        if not exact and not found:
            return len(words), [], []
        count = _WordCount(flat)
        first = sorted((count(s), n) for s, n in exact)
        spans = sorted(
            (label, count(s), count(e - 1), edits, max(0.0, 1 - edits / size)) for (label, s, e), (edits, size) in found.items()
        )
        return len(words), first, spans


    def _best(self, n: int, window: str) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best match of a notice in a window; the same windows come again and again."""
        key = (n, window)
        if key not in self.seen:
            if len(self.seen) >= _KEPT_WINDOWS:
                self.seen.clear()
            match = self.patterns[n].search(window)
            self.seen[key] = match and (sum(match.fuzzy_counts), match.start(), match.end())
        return self.seen[key]


class _WordCount:
    """Number of the word at a place of the normalised text."""

    def __init__(self, flat: str) -> None:
        self.spaces = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le"), np.uint32) == 32)

    def __call__(self, at: int) -> int:
        return int(np.searchsorted(self.spaces, at)) - 1


def _apart(matches: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of the (edits, start, end) that overlap, the ones with the fewest edits; of equals the first."""
    kept: list[tuple[int, int]] = []
    out = []
    for edits, start, end in sorted(matches):
        at = bisect.bisect_left(kept, (start, end))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
            kept.insert(at, (start, end))
            out.append((edits, start, end))
    return out


@lru_cache(maxsize=4)
def _search(phrases: tuple[Notice, ...], notices: tuple[Notice, ...]) -> NoticeSearch:
    return NoticeSearch(phrases, notices)


def scan(
    docs: DataFrame, phrases: tuple[Notice, ...] = PHRASES, notices: tuple[Notice, ...] = NOTICES,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per input row.

    n_words; places (word, label) of the unchanged phrases; spans (label, first and last
    word, start and end in the text's characters, edits, share of the notice unchanged).
    """
    kind = docs.schema[id_column].dataType.simpleString()
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    span = pa.struct([
        ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
        ("edits", pa.int64()), ("unchanged", pa.float64()),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(phrases, notices)
        for batch in batches:
            sizes, places, spans = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n, exact, found = search(text)
                sizes.append(n)
                places.append([{"word": w, "label": search.notices[p].label} for w, p in exact])
                spans.append(_in_text(text, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(place)), pa.array(spans, pa.list_(span))],
                names=["id", "n_words", "places", "spans"],
            )

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run,
        f"id {kind}, n_words long, places array<struct<word: long, label: string>>, spans array<struct<label: string, "
        "first_word: long, last_word: long, start: long, end: long, edits: long, unchanged: double>>",
    )


def _in_text(text: str, found: list[tuple[str, int, int, int, float]]) -> list[dict]:
    """Spans with their places in the text as it is."""
    if not found:
        return []
    wanted = {w for _, first, last, _, _ in found for w in (first, last)}
    # ASCII lower-casing keeps every character's place.
    lowered = text.encode().lower().decode()
    at = {i: m.span() for i, m in enumerate(_WORD.finditer(lowered)) if i in wanted}
    return [
        {"label": label, "first_word": first, "last_word": last, "start": at[first][0], "end": at[last][1], "edits": edits, "unchanged": unchanged}
        for label, first, last, edits, unchanged in found
    ]


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place, labels of the phrases, all labels, and the share unchanged of the best match."""
    joined = lambda column: F.array_join(F.array_sort(F.array_distinct(column)), ",")
    words, base = F.col("places.word"), F.col("places.label")
    return scanned.select(
        "id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.col("spans.label"))).alias("labels"),
        F.coalesce(F.array_max("spans.unchanged"), F.lit(0.0)).alias("score"),
    )
