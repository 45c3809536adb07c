"""Language of documents and of the spans of mixed-language texts.

Each word gets a score for each language: its smoothed log probability among the
learned words, or that of its letter trigrams where it was not learned, as a share of
all languages. The script of a word, from its letters' code ranges, first narrows the
languages to those that use it. A Viterbi pass over the words of a text, with a price for each
switch, labels every word; runs of one label are the spans. The language with the most
letters in its spans is the document's.

The model is fitted on a bounded sample of the labelled rows (``docs_per_language``,
about that many, chosen by a hash of the id, whole texts); everything else covers all
rows and whole texts.

Defined cases: null texts, texts without a letter, and everything where no row is
labelled, get ``und``, score 0 and no spans; rows without text or language are not
learned from; repeated rows count again; equal totals go to the first language in alphabetical
order; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import small_batches

UNKNOWN = "und"
#: Code ranges of the common scripts (fixed values); letters outside are "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
#: Runs of letters and other numerals (fractions, raised digits, numbers in circles, which Unicode counts as word characters). The
#: few runs that hold such a numeral are cut again with ``LETTERS``; asking for it everywhere would cost twice the time.
WORD = re.compile(r"[^\W\d_]+")
#: A language uses a script that holds at least this share of its learned letters.
SCRIPT_SHARE = 0.01
#: Scores of scripts a language does not use, and the least share a language can have of a word.
_OUTSIDE, _LEAST = math.log(1e-6), 1e-4
#: Words whose scores a task remembers, beside those of one piece of text.
_KEPT_WORDS = 100_000


def _letters() -> re.Pattern:
    """Runs of letters alone."""
    numerals = [c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()]
    return re.compile(f"[^\\W\\d_{re.escape(''.join(numerals))}]+")


LETTERS = _letters()


def words_of(text: str) -> list[str]:
    """Runs of letters in a lower-cased text."""
    found = WORD.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return LETTERS.findall(text)


def script_of(word: str) -> str:
    """Script of the first letter."""
    return _script(word[0])


@lru_cache(maxsize=4096)
def _script(letter: str) -> str:
    code = ord(letter)
    for name, ranges in SCRIPTS.items():
        if any(low <= code <= high for low, high in ranges):
            return name
    return "other"


def _trigrams(word: str) -> list[str]:
    marked = f"<{word}>"
    return [marked[i:i + 3] for i in range(len(marked) - 2)]


@dataclass(frozen=True)
class LanguageModel:
    """Log shares by word and trigram; rows of the arrays are languages in alphabetical order."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    trigrams: dict[str, int]
    trigram_scores: np.ndarray
    scripts: dict[str, np.ndarray]

    @staticmethod
    def of_counts(counts: Iterable[tuple[str, str, int]]) -> LanguageModel:
        """From (language, word, count) rows."""
        words: dict[str, int] = {}
        numbers: dict[str, int] = {}
        cells = array("q"), array("q"), array("q")
        for language, word, n in counts:
            for column, value in zip(cells, (words.setdefault(word, len(words)), numbers.setdefault(language, len(numbers)), n)):
                column.append(value)
        languages = sorted(numbers)
        place = np.array([languages.index(x) for x in numbers], np.int64)
        table = np.zeros((len(words), len(languages)))
        at, of, n = (np.frombuffer(c, np.int64) if len(c) else np.empty(0, np.int64) for c in cells)
        np.add.at(table, (at, place[of] if len(of) else of), n)
        grams: dict[str, int] = {}
        owners, places, letters = array("q"), array("q"), {}
        for word, row in words.items():
            for gram in _trigrams(word):
                owners.append(row)
                places.append(grams.setdefault(gram, len(grams)))
            script = script_of(word)
            letters[script] = letters.get(script, 0) + len(word) * table[row]
        gram_table = np.zeros((len(grams), len(languages)))
        for start in range(0, len(places), 100_000):
            own = slice(start, start + 100_000)
            np.add.at(gram_table, np.array(places[own], np.int64), table[np.array(owners[own], np.int64)])
        total = sum(letters.values()) if letters else np.zeros(len(languages))
        scripts = {s: found >= SCRIPT_SHARE * np.maximum(total, 1) for s, found in letters.items()}
        return LanguageModel(languages, words, _log(table), grams, _log(gram_table), scripts)

    def score(self, word: str) -> np.ndarray:
        """Log share of each language; all equal where nothing is known."""
        return self.scores([word])[0]

    def scores(self, words: list[str]) -> np.ndarray:
        """``score`` of each word."""
        out = np.full((len(words), len(self.languages)), -math.log(len(self.languages)))
        rows = np.array([self.words.get(w, -1) for w in words], np.int64)
        learned = rows >= 0
        out[learned] = self.word_scores[rows[learned]]
        others = np.flatnonzero(~learned)
        found = [[i for i in map(self.trigrams.get, _trigrams(words[k])) if i is not None] for k in others.tolist()]
        sizes = np.array([len(f) for f in found], np.int64)
        if sizes.any():
            starts = (np.cumsum(sizes) - sizes)[sizes > 0]
            grams = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
            out[others[sizes > 0]] = _shares(np.add.reduceat(self.trigram_scores[grams], starts, axis=0))
        names = list(map(script_of, words))
        for script in set(names):
            own = np.array([n == script for n in names])
            allowed = self.scripts.get(script)
            if allowed is None or not allowed.any():
                out[own] = -math.log(len(self.languages))
            else:
                out[np.ix_(own, ~allowed)] = _OUTSIDE
        return out


def _log(table: np.ndarray) -> np.ndarray:
    """Per row, the log share of each column after scaling the columns to equal sums."""
    if not table.size:
        return table
    smoothed = (table + 0.5) / (table.sum(axis=0) + 0.5 * len(table))
    return _shares(np.log(smoothed))


def _shares(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return np.log(np.maximum(shifted / shifted.sum(axis=-1, keepdims=True), _LEAST))


def fit(
    docs: DataFrame, label_column: str = "lang", text_column: str = "text", id_column: str = "doc_id",
    docs_per_language: int = 1000,
) -> LanguageModel:
    """Fit on about ``docs_per_language`` rows of each language, with all their words."""
    rows = docs.select(F.col(label_column).alias("language"), F.col(text_column).alias("text"), F.xxhash64(F.col(id_column)).alias("h"))
    rows = rows.where("language IS NOT NULL AND text IS NOT NULL")
    shares = rows.groupBy("language").agg(F.least(F.lit(1.0), F.lit(float(docs_per_language)) / F.count(F.lit(1))).alias("share"))
    # One row for each language.
    chosen = rows.join(F.broadcast(shares), "language").where("h / 18446744073709551616 + 0.5 <= share").select("language", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.setdefault(language, Counter()).update(words_of(text.as_py().lower()))
            rows = [(language, word, n) for language, counter in found.items() for word, n in counter.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))],
                names=["language", "word", "n"],
            )

    counts = chosen.mapInArrow(count, "language string, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n"))
    # The words of a bounded sample, as columns.
    found = counts.toArrow().sort_by([("language", "ascending"), ("word", "ascending")])
    return LanguageModel.of_counts(row for batch in found.to_batches() for row in zip(*(c.to_pylist() for c in batch.columns)))


class _WordRows(dict):
    """Word to row of a growing table of scores and lengths; unseen words are scored on first sight, many at once."""

    def __init__(self, model: LanguageModel) -> None:
        super().__init__()
        self.model, self.scores = model, np.zeros((1024, len(model.languages)), np.float32)
        self.lengths = np.zeros(1024, np.int64)
        self.odd = False  # whether a run with a numeral has been seen

    def learn(self, words: list[str], at_once: int = 4096) -> None:
        for start in range(0, len(words), at_once):
            part, row = words[start:start + at_once], len(self)
            while row + len(part) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.scores[row:row + len(part)] = self.model.scores(part)
            self.lengths[row:row + len(part)] = list(map(len, part))
            self.update(zip(part, range(row, row + len(part))))

    def bounded(self) -> _WordRows:
        """These rows, or empty ones once there are too many."""
        return self if len(self) <= _KEPT_WORDS else _WordRows(self.model)


def viterbi(rows: np.ndarray, lengths: np.ndarray, scores: np.ndarray, switch_price: float) -> np.ndarray:
    """Labels of the words of many texts at once.

    rows: score row of every word, text after text; lengths: words of each text, longest
    first, none empty. Texts advance together, one word a step.
    """
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    stays = np.empty((len(rows), scores.shape[1]), bool)
    best = np.empty(len(rows), np.int32)
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    value = scores[rows[starts]].astype(np.float64)
    for t in range(1, lengths[0]):
        k = active[t]
        v = value[:k]
        top = v.argmax(axis=1)
        switch = v[np.arange(k), top][:, None] - switch_price
        at = starts[:k] + t
        best[at] = top
        stays[at] = v >= switch
        value[:k] = np.maximum(v, switch) + scores[rows[at]]
    labels = np.empty(len(rows), np.int32)
    now = value.argmax(axis=1)
    for t in range(lengths[0] - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        labels[at] = now[:k]
        if t:
            now[:k] = np.where(stays[at, now[:k]], now[:k], best[at])
    return labels


def identify(
    docs: DataFrame, model: LanguageModel, switch_price: float = 8.0, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """id, language, score (share of the letters that are in its spans), spans (start, end, language).

    Spans are places in the text, in characters; each runs from its first word's start to its last word's end.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("language", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordRows(shared.value)
        for batch in batches:
            answers = []
            for piece in _pieces(batch.column(1)):
                known = known.bounded()
                answers += _label(piece, known, switch_price)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a[0] for a in answers], pa.string()), pa.array([a[1] for a in answers], pa.float64()),
                 pa.array([a[2] for a in answers], pa.list_(span))],
                names=["id", "language", "score", "spans"],
            )

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, language string, score double, spans array<struct<start: long, end: long, language: string>>"
    )


def with_language(
    docs: DataFrame, model: LanguageModel, switch_price: float = 8.0, text_column: str = "text"
) -> DataFrame:
    """The rows for which a language is found, with all their columns; the others are rejected.

    Where the model has learned nothing, only texts without a letter are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    small_batches(docs.sparkSession)

    # The texts alone go to Python, and nothing comes back but the answer.
    @F.arrow_udf("boolean")
    def known_language(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _has_language(texts, shared.value, switch_price)
        # The worker stays after its task.
        pa.default_memory_pool().release_unused()

    return docs.where(known_language(F.col(text_column)))


def _has_language(columns: Iterable[pa.Array], model: LanguageModel, switch_price: float) -> Iterator[pa.Array]:
    """For each text whether a language is found, or a letter where none was learned."""
    known = _WordRows(model)
    for column in columns:
        keep = []
        for piece in _pieces(column):
            known = known.bounded()
            if model.languages:
                keep += [a[0] != UNKNOWN for a in _label(piece, known, switch_price)]
            else:
                keep += [bool(LETTERS.search(t)) for t in piece]
        yield pa.array(keep, pa.bool_())


def _pieces(column: pa.Array, most_chars: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in order, in lists of a bounded size (or of one text)."""
    piece, size = [], 0
    for value in column:
        text = value.as_py() or ""
        if piece and size + len(text) > most_chars:
            yield piece
            piece, size = [], 0
        piece.append(text)
        size += len(text)
    if piece:
        yield piece


def _label(texts: list[str], known: _WordRows, switch_price: float) -> list[tuple]:
    languages = known.model.languages
    words = [WORD.findall(t.lower()) for t in texts]
    pattern = [WORD] * len(texts)
    fresh = [w for w in set(chain.from_iterable(words)) if w not in known]
    # Scored on first sight; ``odd`` where one is not of letters alone.
    known.odd |= not all(map(str.isalpha, fresh))
    if known.odd:
        for i, own in enumerate(words):
            if not all(map(str.isalpha, own)):
                words[i], pattern[i] = LETTERS.findall(texts[i].lower()), LETTERS
        fresh = [w for w in set(chain.from_iterable(words)) if w not in known]
    lengths = np.array([len(w) for w in words])
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0] if languages else order[:0]
    answers: list[tuple] = [(UNKNOWN, 0.0, [])] * len(texts)
    if not len(order):
        return answers
    known.learn(fresh)
    rows = np.fromiter(map(known.__getitem__, chain.from_iterable(words[i] for i in order)), np.int64, int(lengths[order].sum()))
    letters = known.lengths[rows]
    labels = viterbi(rows, lengths[order], known.scores, switch_price)
    which = np.repeat(np.arange(len(order)), lengths[order])
    sums = np.bincount(which * len(languages) + labels, letters, len(order) * len(languages)).reshape(len(order), -1)
    start = 0
    for place, i in enumerate(order):
        best = int(sums[place].argmax())
        own = labels[start:start + lengths[i]]
        start += lengths[i]
        answers[i] = (languages[best], float(sums[place, best] / sums[place].sum()), _spans(texts[i], own, languages, pattern[i]))
    return answers


def _spans(text: str, labels: np.ndarray, languages: list[str], pattern: re.Pattern) -> list[dict]:
    if (labels == labels[0]).all():
        first = pattern.search(text)
        end = len(text)
        while not pattern.match(text[end - 1]):
            end -= 1
        return [{"start": first.start(), "end": end, "language": languages[labels[0]]}]
    cuts = np.flatnonzero(np.diff(labels)) + 1
    places = [m.span() for m in pattern.finditer(text)]
    if len(places) != len(labels):  # lower-casing can make more characters of one
        places = [m.span() for m in pattern.finditer(text.lower())]
    return [
        {"start": places[a][0], "end": places[b - 1][1], "language": languages[labels[a]]}
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(labels)])
    ]
