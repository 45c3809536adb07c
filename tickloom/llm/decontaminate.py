"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap of question and answer.

The inverted index holds the test items. Scores are divided by the item's score for
itself, so one threshold fits items of any length: 1 means that a passage has all the
item's words. A document is cut in overlapping passages, each long enough to hold any
item with room to spare, and every passage is a query:

1. a passage whose terms' largest scores add up to less than the threshold is done (WAND);
2. of the rest, for each block of items the largest scores of the passage's terms in that block
   add up to a bound; blocks below the threshold are skipped (block-max);
3. items of the remaining blocks get their exact score; all at or above the threshold are kept.

A kept item is verified on the words around the passage: at least ``overlap`` of the
question's and of the answer's distinct word shingles must stand there.

Items are indexed in blocks of about ``items_per_index``, each built by a task from its items; all documents are read against
each. The number of items, their mean length and the items with a term are counted over all items first,
so a score does not depend on the block.

Defined cases: null and wordless texts and items match nothing; items shorter than a
shingle are one shingle of all their words; repeated documents are searched each;
repeated items report each id; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tickloom.llm.shared import stored

WORD = re.compile(r"\w+")
#: Constants of BM25.
K1, B = 1.2, 0.75
#: Passages whose bounds are computed at once times the blocks of the index.
_CELLS = 1_000_000


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: up to the last question mark or line break, or all but the last sentence."""
    body = text.rstrip()
    cut = max(body.rfind("?"), body.rfind("\n"))
    if cut < 0 or cut == len(body) - 1:
        stops = [m.end() for m in re.finditer(r"[.!?]\s", body)]
        cut = stops[-1] if stops else len(body)
    else:
        cut += 1
    return WORD.findall(body[:cut].casefold()), WORD.findall(body[cut:].casefold())


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


@dataclass
class ItemIndex:
    """Postings of a set of items, and the largest score of each term in each block of items.

    The blocks of term t are block_start[t] to block_start[t + 1], the items of the b-th of these are
    item_start[b] to item_start[b + 1].
    """

    ids: list
    words: list[list[str]]
    parts: list[tuple[set, set]]
    terms: dict[str, int]
    largest: np.ndarray
    block_start: np.ndarray
    block_of: np.ndarray
    block_score: np.ndarray
    item_start: np.ndarray
    item_of: np.ndarray
    item_score: np.ndarray
    block_items: int
    shingle_words: int

    @staticmethod
    def build(
        items: list[tuple[object, str | None]], frequency: Mapping[str, int], n_items: int, mean: float, block_items: int = 16, shingle_words: int = 5
    ) -> ItemIndex:
        """``frequency`` (items with a term), ``n_items`` and ``mean`` (words an item) are those of all items, not of these alone."""
        # Items with common words stand together, so that a block's bounds are tight.
        split = [(item, *split_item(text or "")) for item, text in items]
        split = sorted((x for x in split if x[1] or x[2]), key=lambda x: (sorted(x[1] + x[2])[len(x[1] + x[2]) // 2], x[1], x[2], str(x[0])))
        words = [question + answer for _, question, answer in split]
        counts = [Counter(w) for w in words]
        terms = {t: i for i, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        idf = {t: math.log(1 + (n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) for t in terms}
        postings: list[list[tuple[int, float]]] = [[] for _ in terms]
        for item, (w, c) in enumerate(zip(words, counts)):
            raw = {terms[t]: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for t, n in c.items()}
            whole = sum(raw.values())
            for t, score in raw.items():
                postings[t].append((item, score / whole))
        term = np.repeat(np.arange(len(terms)), [len(own) for own in postings])
        item_of = np.array([item for own in postings for item, _ in own], np.int64)
        item_score = np.array([score for own in postings for _, score in own], np.float64)
        n_blocks = max(1, -(-len(words) // block_items))
        entries, item_start = np.unique(term * n_blocks + item_of // block_items, return_index=True)
        block_score = np.maximum.reduceat(item_score, item_start) if len(entries) else item_score
        block_start = np.searchsorted(entries, np.arange(len(terms) + 1) * n_blocks)
        return ItemIndex(
            [x[0] for x in split], words, [(shingles(q, shingle_words), shingles(a, shingle_words)) for _, q, a in split], terms,
            np.maximum.reduceat(block_score, block_start[:-1]) if len(entries) else np.zeros(1),
            block_start, entries % n_blocks, block_score, np.append(item_start, len(item_of)), item_of, item_score,
            block_items, shingle_words,
        )

    @property
    def longest(self) -> int:
        return max(map(len, self.words), default=0)

    def candidates(self, numbers: np.ndarray, passage: np.ndarray, n_passages: int, threshold: float) -> list[tuple[int, int, float]]:
        """(passage, item, score) of all scores at or above the threshold.

        numbers, passage: distinct (passage, term) pairs in order of passage.
        """
        limit = threshold * (1 - 1e-9)
        bound = np.bincount(passage, self.largest[numbers], n_passages)
        alive = bound >= limit
        keep = alive[passage]
        numbers, passage = numbers[keep], passage[keep]
        n_blocks = -(-len(self.ids) // self.block_items)
        found = []
        live = np.flatnonzero(alive)
        step = max(1, _CELLS // max(1, n_blocks))
        for at in range(0, len(live), step):
            group = live[at:at + step]
            a, b = np.searchsorted(passage, [group[0], group[-1] + 1])
            own, where = numbers[a:b], np.searchsorted(group, passage[a:b])
            places, source = _expand(self.block_start, own)
            cells = where[source] * n_blocks + self.block_of[places]
            bounds = np.bincount(cells, self.block_score[places], len(group) * n_blocks)
            # Exact scores in the blocks whose bound reaches the threshold.
            open_ = np.flatnonzero(bounds >= limit)
            inside = np.flatnonzero(bounds[cells] >= limit)
            posts, source = _expand(self.item_start, places[inside])
            item = self.item_of[posts]
            slot = np.searchsorted(open_, cells[inside])[source] * self.block_items + item % self.block_items
            scores = np.bincount(slot, self.item_score[posts], len(open_) * self.block_items)
            hits = np.flatnonzero(scores >= limit)
            which, block = np.divmod(open_[hits // self.block_items], n_blocks)
            item = block * self.block_items + hits % self.block_items
            there = item < len(self.ids)  # the last block may be short
            found += zip(group[which][there].tolist(), item[there].tolist(), scores[hits][there].tolist())
        return found


def _expand(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the given rows of a list of lists, and for each place the position of its row."""
    sizes = starts[rows + 1] - starts[rows]
    source = np.repeat(np.arange(len(rows)), sizes)
    return np.arange(len(source)) + (starts[rows] - np.cumsum(sizes) + sizes)[source], source


class PassageSearch:
    def __init__(self, index: ItemIndex, threshold: float, overlap: float) -> None:
        self.index, self.threshold, self.overlap = index, threshold, overlap
        self.size = max(64, 2 * index.longest)
        self.stride = self.size - index.longest

    def __call__(self, texts: list[str]) -> list[tuple[int, int, float, float, float, int]]:
        """(text, item, score, question overlap, answer overlap, first word of the best passage), best passage of each."""
        index = self.index
        found_words = [WORD.findall(t.casefold()) for t in texts]
        counts = np.array([max(1, -(-max(0, len(w) - index.longest) // self.stride)) for w in found_words], np.int64)
        first = np.cumsum(counts) - counts
        keys = []
        n_terms = max(1, len(index.terms))
        for words, start in zip(found_words, first.tolist()):
            numbers = np.fromiter(map(index.terms.get, words, repeat(-1)), np.int64, len(words))
            at = np.flatnonzero(numbers >= 0)
            # A word is in the passage that begins at or before it, and in the one before that if it reaches so far.
            own = np.minimum(at // self.stride, counts[len(keys)] - 1)
            before = at - (own - 1) * self.stride < self.size
            before &= own > 0
            keys.append(np.unique(np.concatenate((
                (start + own) * n_terms + numbers[at], (start + own[before] - 1) * n_terms + numbers[at[before]]
            ))))
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        best: dict[tuple[int, int], tuple] = {}
        for passage, item, score in index.candidates(key % n_terms, key // n_terms, int(counts.sum()), self.threshold):
            text = int(np.searchsorted(first, passage, side="right")) - 1
            start = (passage - int(first[text])) * self.stride
            question, answer = self._verify(found_words[text], start, item)
            if min(question, answer) >= self.overlap:
                row = (score, question, answer, start)
                best[text, item] = max(best.get((text, item), row), row)
        return [(*key, *row) for key, row in sorted(best.items())]

    def _verify(self, words: list[str], start: int, item: int) -> tuple[float, float]:
        index = self.index
        slack = len(index.words[item])
        around = words[max(0, start - slack):start + self.size + slack]
        there = set(zip(*(around[i:] for i in range(index.shingle_words))))
        question, answer = index.parts[item]
        return self._share(question, there, around), self._share(answer, there, around)

    def _share(self, part: set[tuple[str, ...]], there: set[tuple[str, ...]], around: list[str]) -> float:
        """Share of the shingles that stand in the words around; 1 where there are none to ask for."""
        if not part:
            return 1.0
        size = len(next(iter(part)))
        if size != self.index.shingle_words:
            there = set(zip(*(around[i:] for i in range(size))))
        return len(part & there) / len(part)


def _words(text: str | None) -> list[str]:
    question, answer = split_item(text or "")
    return question + answer


def item_indexes(items: DataFrame, items_per_index: int, id_column: str = "item_id", text_column: str = "text") -> Iterator[ItemIndex]:
    """The index of each block of items, one at a time."""
    rows = stored(items.select(F.col(id_column).alias("item"), F.col(text_column).alias("text")).withColumn("key", F.monotonically_increasing_id()), "items")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, terms, lengths = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words(text)
                for place, term in enumerate(dict.fromkeys(words)):
                    keys.append(key)
                    terms.append(term)
                    lengths.append(0 if place else len(words))  # once an item
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(terms, pa.string()), pa.array(lengths, pa.int64())], names=["key", "term", "length"])

    terms = stored(rows.select("key", "text").mapInArrow(count, "key long, term string, length long"), "item-terms")
    n_items, total = terms.agg(F.count_if(F.col("length") > 0), F.coalesce(F.sum("length"), F.lit(0))).first()
    if not n_items:
        return
    blocks = -(-n_items // items_per_index)
    counted = terms.join(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term").groupBy("key").agg(
        F.collect_list("term").alias("terms"), F.collect_list("n").alias("counts"))
    whole = rows.join(counted, "key").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))

    def build(block: pa.Table) -> pa.Table:
        frequency: dict[str, int] = {}
        for own, n in zip(block["terms"], block["counts"]):
            frequency.update(zip(own.as_py(), n.as_py()))
        index = ItemIndex.build(list(zip(block["item"].to_pylist(), block["text"].to_pylist())), frequency, n_items, total / n_items)
        return pa.table({"index": pa.array([pickle.dumps(index)], pa.binary())})

    for row in whole.select("block", "item", "text", "terms", "counts").groupBy("block").applyInArrow(build, "index binary").toLocalIterator():
        yield pickle.loads(row["index"])


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.5,
    overlap: float = 0.8,
    items_per_index: int = 50_000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """id, item_id, score, question_overlap, answer_overlap, first_word: a row for each document and item found in it."""
    kind, item_kind = docs.schema[id_column].dataType.simpleString(), items.schema["item_id"].dataType
    schema = f"id {kind}, item_id {item_kind.simpleString()}, score double, question_overlap double, answer_overlap double, first_word long"
    columns = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    item_type = to_arrow_type(item_kind)
    spark, results = docs.sparkSession, []
    for index in item_indexes(items, items_per_index):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = PassageSearch(shared.value, threshold, overlap)
            for batch in batches:
                rows = []
                for start, texts in _pieces(batch.column(1)):
                    rows += [(start + t, *rest) for t, *rest in search(texts)]
                ids = [search.index.ids[r[1]] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array(ids, item_type)]
                    + [pa.array([r[i] for r in rows], t) for i, t in ((2, pa.float64()), (3, pa.float64()), (4, pa.float64()), (5, pa.int64()))],
                    names=["id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
                )

        results.append(columns.mapInArrow(run, schema))
    if not results:
        return spark.createDataFrame([], schema)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found


def _pieces(column: pa.Array, most_chars: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """(row of the first, texts) in lists of a bounded size, or of one text."""
    start, texts, size = 0, [], 0
    for row, value in enumerate(column):
        text = value.as_py() or ""
        if texts and size + len(text) > most_chars:
            yield start, texts
            start, texts, size = row, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield start, texts


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.5,
    overlap: float = 0.8,
    items_per_index: int = 50_000,
    text_column: str = "text",
) -> DataFrame:
    """The documents in which no item is found, with all their columns; no row moves."""
    spark, clean, at = docs.sparkSession, docs, docs.columns.index(text_column)
    for index in item_indexes(items, items_per_index):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = PassageSearch(shared.value, threshold, overlap)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for start, texts in _pieces(batch.column(at)):
                    keep[[start + hit[0] for hit in search(texts)]] = False
                yield batch.filter(pa.array(keep))

        clean = clean.mapInArrow(run, docs.schema)
    return clean
