"""Hard-negative mining by Fagin's threshold algorithm.

The rows are dealt into blocks of bounded size and the anchors into parts; every part of the anchors meets every block
in a group of its own. There each dimension has a sorted list of the block's rows. An anchor reads
all lists from the side its sign asks for, a stretch at a time; rows that appear are scored
in whole numbers by random access. No row that has not appeared scores more than the sum of the last entries read (the
threshold). Two searches use it, as the second needs what the first finds:

1. positives: rows of the anchor's label; reading ends once the threshold is strictly below the k-th score;
2. negatives: rows of another label with a score in a window below each positive's; reading ends once the threshold is strictly
   below the k-th score of every window, or below its lower end.

Strictly below: rows that tie with the k-th have all appeared, and the smaller id can win. The blocks' best rows are
joined by a window of bounded groups (k rows a block); nothing is broadcast or sent to the driver but two row counts.

Defined cases: rows with a null label or an unusable vector (null, empty, null or non-finite entries) take no part. Rows are told
apart by where they lie, so a repeated row is another row, also of itself, and a repeated anchor answers for each. A null id
comes after all others in ties. An all-zero anchor reads everything. Anchors without positives, and windows without rows, give none; empty tables
an empty result. Vectors of different lengths, or entries so large that a score may not fit a long, raise. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import stored
from tickloom.llm.vectors import matrix, usable
from tickloom.session import ship_module

ship_module(__name__)

#: Rows read from each list at first; each further stretch is twice as long.
_STRETCH = 32
_NO_ID = np.iinfo(np.int64).max


class SortedLists:
    """Rows of a block, and for each dimension their order by its entry."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        if x.size and float(np.abs(x.astype(float)).max()) ** 2 * x.shape[1] > 2.0**62:
            raise OverflowError("the scores of these vectors may not fit a long")
        self.keys, self.ids, self.labels, self.x = keys, ids, labels, x
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Rows that have appeared, their scores, and the threshold, after each stretch."""
        n = len(self.x)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) and not len(down):
            yield np.arange(n), np.zeros(n, np.int64), -np.inf
            return
        seen = np.zeros(n, bool)
        rows, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, stretch = 0, _STRETCH
        while len(rows) < n:
            until = min(n, depth + stretch)
            met = np.zeros(n, bool)
            met[self.order[up, n - until:n - depth].ravel()] = True
            met[self.order[down, depth:until].ravel()] = True
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            rows = np.concatenate((rows, fresh))
            scores = np.concatenate((scores, self.x[fresh] @ anchor))
            depth, stretch = until, 2 * stretch
            last = (anchor[up] * self.x[self.order[up, n - depth], up]).sum() + (anchor[down] * self.x[self.order[down, depth - 1], down]).sum()
            yield rows, scores, last if len(rows) < n else -np.inf

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k by falling score, then id, then place."""
        if len(rows) > k:
            near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[near], scores[near]
        at = np.lexsort((self.keys[rows], self.ids[rows], -scores))[:k]
        return rows[at], scores[at]

    def positives(self, key: int, label: object, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for rows, scores, threshold in self.read(anchor):
            fit = (self.labels[rows] == label) & (self.keys[rows] != key)
            rows, scores = rows[fit], scores[fit]
            if _settled(scores, k, threshold):
                break
        return self.best(rows, scores, k)

    def negatives(self, label: object, anchor: np.ndarray, k: int, ranges: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each range of scores the first k rows of another label."""
        found = [(np.empty(0, np.int64),) * 2 for _ in ranges]
        for rows, scores, threshold in self.read(anchor):
            other = self.labels[rows] != label
            rows, scores = rows[other], scores[other]
            open_ = False
            for i, (low, high) in enumerate(ranges):
                inside = (scores >= low) & (scores <= high)
                found[i] = rows[inside], scores[inside]
                open_ |= low <= high and threshold >= low and not _settled(found[i][1], k, threshold)
            if not open_:
                break
        return [self.best(*f, k) for f in found]


def _settled(scores: np.ndarray, k: int, threshold: float) -> bool:
    return len(scores) >= k and threshold < np.partition(scores, len(scores) - k)[len(scores) - k]


def _block(table: pa.Table) -> SortedLists:
    ids = table["id"].combine_chunks()
    ids = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
    labels = table["label"].combine_chunks().to_numpy(zero_copy_only=False)
    return SortedLists(table["key"].to_numpy(), ids, labels, matrix(table["vector"].combine_chunks()))


def _table(columns: dict[str, list[np.ndarray]], names: list[str]) -> pa.Table:
    return pa.table({n: np.concatenate(columns[n]) if columns[n] else np.empty(0, np.int64) for n in names})


def _meet(anchors: DataFrame, rows: DataFrame, blocks: int, parts: int, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``search`` on every part of the anchors with every block."""
    part = F.pmod(F.hash("key"), F.lit(parts))
    left = anchors.withColumns({"part": part, "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(search, schema)


def _first(df: DataFrame, by: list[str], prefix: str, k: int) -> DataFrame:
    """The first k of each group over all blocks, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc(f"{prefix}_score"), F.asc_nulls_last(f"{prefix}_id"), f"{prefix}_key")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90,
    block_rows: int = 4096, anchor_rows: int = 16384,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has id (long), label and vector (array of long); ``is_anchor`` is a condition on these. A negative's score lies between the
    two percentages of its positive's. ``block_rows`` and ``anchor_rows`` bound what a group holds and do not change the result; every
    row is copied to as many groups as there are parts of anchors, every anchor to as many as there are blocks.
    """
    usable_rows = vectors.where(F.col("label").isNotNull() & usable(F.col("vector"))).select(
        "id", "label", "vector", F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    n = usable_rows.count()
    blocks = max(1, -(-n // block_rows))
    rows = stored(usable_rows.repartition(blocks).select(
        F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("key"), "*"), "vector-blocks")
    anchors = rows.where("anchor").select("key", "id", "label", "vector")
    parts = max(1, -(-anchors.count() // anchor_rows))
    rows = rows.select("block", "key", "id", "label", "vector")

    def find_positives(own: pa.Table, block: pa.Table) -> pa.Table:
        names = ["key", "positive_key", "positive_id", "positive_score"]
        out: dict[str, list[np.ndarray]] = {c: [] for c in names}
        if own.num_rows and block.num_rows:
            lists = _block(block)
            labels = own["label"].combine_chunks().to_numpy(zero_copy_only=False)
            for key, label, x in zip(own["key"].to_numpy(), labels, matrix(own["vector"].combine_chunks())):
                at, scores = lists.positives(key, label, x, positives)
                for c, values in zip(names, (np.full(len(at), key), lists.keys[at], lists.ids[at], scores)):
                    out[c].append(values)
        return _table(out, names)

    found = _meet(
        anchors, rows, blocks, parts, find_positives, "key long, positive_key long, positive_id long, positive_score long")
    windows = _first(found, ["key"], "positive", positives).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("windows"))
    asking = stored(anchors.join(windows, "key"), "anchors-with-positives")

    def find_negatives(own: pa.Table, block: pa.Table) -> pa.Table:
        names = ["key", "anchor_id", "window", "positive_id", "positive_score", "negative_key", "negative_id", "negative_score"]
        out: dict[str, list[np.ndarray]] = {c: [] for c in names}
        if own.num_rows and block.num_rows:
            lists = _block(block)
            labels = own["label"].combine_chunks().to_numpy(zero_copy_only=False)
            vectors_ = matrix(own["vector"].combine_chunks())
            for key, ident, label, x, ranks in zip(own["key"].to_numpy(), own["id"].to_pylist(), labels, vectors_, own["windows"].to_pylist()):
                ranges = [(-(-low_percent * w["positive_score"] // 100), high_percent * w["positive_score"] // 100) for w in ranks]
                for w, (at, scores) in zip(ranks, lists.negatives(label, x, negatives, ranges)):
                    same = (key, _NO_ID if ident is None else ident, w["rank"], w["positive_id"], w["positive_score"])
                    for c, values in zip(names, (*(np.full(len(at), s, np.int64) for s in same), lists.keys[at], lists.ids[at], scores)):
                        out[c].append(values)
        return _table(out, names)

    schema = "key long, anchor_id long, window long, positive_id long, positive_score long, negative_key long, negative_id long, negative_score long"
    answers = _first(_meet(asking, rows, blocks, parts, find_negatives, schema), ["key", "window"], "negative", negatives)
    known = {c: F.when(F.col(c) != int(_NO_ID), F.col(c)).alias(c) for c in ("anchor_id", "positive_id", "negative_id")}
    return answers.select(known["anchor_id"], known["positive_id"], "rank", known["negative_id"], "positive_score", "negative_score")
