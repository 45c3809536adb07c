"""Removal of repeated byte strings by a sparse, distributed difference-cover suffix array.

A difference cover is a sample of text positions such that equal strings of the length asked for
meet it at equal offsets. Here each window of ``length`` bytes is covered by the
leftmost smallest hash of the grams inside it, so equal windows share the sampled gram and its
offset, wherever they stand; about one position in 35 is sampled (for 100 bytes).

1. Sampled grams are counted. Windows whose gram occurs once cannot be repeated and go no
   further. A filter of bounded size holds the repeated grams; where it errs, it lets more through.
2. The sampled suffixes of one gram come together (a shuffle by the gram's hash). Triples of their
   words are sorted and named, and triples of names in turn, until a name stands for the whole
   length: the names order the sampled suffixes.
3. The remaining suffixes, those that start ``o`` bytes before a sample, are merged in: one is ordered
   by its ``o`` bytes and then by its sample's place, and their classes follow from both.
4. Prefixes of neighbours are compared; of equal ones all but the earliest are removed.

A context that occurs twice in a task is sent once. Grams with more than ``hot_rows`` rows are
not brought together: their windows are grouped by their own bytes, which no key's size hurts.

Defined cases: null texts are empty; texts shorter than ``length`` lose nothing; null ids come
last in the order; rows with equal ids are ordered by a hash of their text, rows equal in both
count as one text and get the same answer; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.shared import stored

GRAM = 32
#: A text's windows are looked at in pieces of this many; their places fit in the low bits of a key.
_PIECE, _PLACE_BITS = 1 << 19, 20
_LAST = (1 << 63) - 1
_ROW = "gram long, place long, tie long, start long, sample int, context binary"
_FIELDS = [("gram", pa.int64()), ("place", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("sample", pa.int32()), ("context", pa.binary())]
_CHUNK_ROWS = 60_000


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``GRAM`` bytes."""
    value, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < GRAM:
        value = (value[:-size] * np.uint64(0x9E3779B97F4A7C15)) ^ (value[size:] * np.uint64(0x61C8864680B583EB))
        value ^= value >> np.uint64(29)
        size *= 2
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` values in a row."""
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - size:width - size + n])


def samples(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gram hash, first and last window start, sampled position: one entry for each run of windows with one sample."""
    width = length - GRAM + 1
    grams, firsts, lasts, places = [], [], [], []
    for begin in range(0, max(0, len(data) - length + 1), _PIECE):
        own = gram_hashes(data[begin:begin + _PIECE + length - 1])
        low = np.uint64((1 << _PLACE_BITS) - 1)
        key = (own & ~low) | np.arange(len(own), dtype=np.uint64)
        at = (_smallest(key, width) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:] - 1, [len(at) - 1]))
        place = at[first]
        grams.append(own[place].view(np.int64))
        firsts.append(begin + first)
        lasts.append(begin + last)
        places.append(begin + place)
    if not grams:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in (grams, firsts, lasts, places))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


class Membership:
    """A filter of bounded size: no member is missed, some others pass."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        return self._bit(keys & self.mask) & self._bit((keys >> np.uint64(27)) & self.mask)

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0

    @staticmethod
    def of(keys: DataFrame, most_bits: int = 1 << 27) -> Membership:
        """keys: one long column. The words reach the driver already merged, at most ``most_bits / 64`` of them."""
        size = 1 << 12
        while size < min(most_bits, 16 * keys.count()):
            size *= 2
        key = keys.columns[0]
        spots = F.array(*[F.expr(f"shiftrightunsigned({key}, {shift}) & {size - 1}L") for shift in (0, 27)])
        words = keys.select(F.explode(spots).alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(
            F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")
        ).toArrow()
        out = np.zeros(size // 64, np.uint64)
        out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        return Membership(out)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text, ident = F.col(text_column), F.col(id_column)
    if isinstance(docs.schema[id_column].dataType, T.IntegralType):
        placed = docs.select(ident.alias("id"), ident.cast("long").alias("place"), text.alias("text"))
    else:
        # Ids of other types: their places in the sorted order, from a distributed sort.
        order = stored(docs.select(ident.alias("id")).where("id IS NOT NULL").distinct().orderBy("id").select(
            "id", F.monotonically_increasing_id().alias("place")), "id-order")
        placed = docs.select(ident.alias("id"), text.alias("text")).join(order, "id", "left")
    return placed.select("id", F.coalesce("place", F.lit(_LAST)).alias("place"), F.xxhash64("text").alias("tie"), "text")


def gram_counts(texts: DataFrame, length: int) -> DataFrame:
    """gram, n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [np.empty(0, np.int64)], 0
            for text in batch.column(0):
                found.append(samples(_bytes(text.as_py()), length)[0])
                size += len(found[-1])
                if size > 500_000:
                    yield _grams(found)
                    found, size = [np.empty(0, np.int64)], 0
            yield _grams(found)

    return texts.select("text").mapInArrow(run, "gram long, n int").groupBy("gram").agg(F.sum("n").alias("n"))


def _grams(found: list[np.ndarray]) -> pa.RecordBatch:
    grams, n = np.unique(np.concatenate(found), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n.astype(np.int32))], names=["gram", "n"])


def contexts(texts: DataFrame, length: int, repeated, hot: np.ndarray, want_hot: bool) -> DataFrame:
    """A row for each sample whose gram is repeated: the bytes of its windows, and where the sample stands in them.

    Of contexts equal within a task the earliest is sent with its bytes; the others, whose windows are all
    repeated, as places alone (``sample`` is the number of windows, ``context`` null).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = repeated.value
        for batch in batches:
            held: dict[tuple[int, bytes, int], tuple[int, int, int]] = {}
            rows: list[tuple] = []
            places, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            size = 0
            for place, tie, text in zip(places, ties, batch.column(2)):
                data = (text.as_py() or "").encode()
                grams, first, last, sample = samples(np.frombuffer(data, np.uint8), length)
                keep = np.flatnonzero(known(grams))
                if len(hot):
                    keep = keep[np.isin(grams[keep], hot) == want_hot]
                for gram, a, b, s in zip(*(x[keep].tolist() for x in (grams, first, last, sample))):
                    content = data[a:b + length]
                    key, own = (gram, content, s - a), (place, tie, a)
                    other = held.setdefault(key, own)
                    if other == own:
                        size += len(content)
                    elif other < own:
                        rows.append((gram, *own, b - a + 1, None))
                    else:
                        held[key] = own
                        rows.append((gram, *other, b - a + 1, None))
                if size + 50 * len(rows) > 32_000_000:
                    yield _context_rows(held, rows)
                    held, rows, size = {}, [], 0
            yield _context_rows(held, rows)

    return texts.select("place", "tie", "text").mapInArrow(run, _ROW)


def _context_rows(held: dict, rows: list[tuple]) -> pa.RecordBatch:
    rows = rows + [(gram, *own, s, content) for (gram, content, s), own in held.items()]
    columns = list(zip(*rows)) or [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], names=[n for n, _ in _FIELDS])


def _names(columns: np.ndarray) -> np.ndarray:
    """Order-keeping names of rows: triples of columns are sorted and named, then triples of the names."""
    while columns.shape[1] > 1:
        if columns.shape[1] % 3:
            columns = np.concatenate((columns, np.zeros((len(columns), 3 - columns.shape[1] % 3), columns.dtype)), axis=1)
        named = np.empty((len(columns), columns.shape[1] // 3), np.int64)
        for i in range(named.shape[1]):
            a, b, c = columns[:, 3 * i:3 * i + 3].T
            order = np.lexsort((c, b, a))
            new = np.concatenate(([False], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0) | (np.diff(c[order]) != 0)))
            named[order, i] = np.cumsum(new)
        columns = named
    return columns[:, 0]


def _common(matrix: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before it in the order; 0 for the first."""
    differ = matrix[order[1:]] != matrix[order[:-1]]
    return np.concatenate(([0], np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])))


def repeated_windows(group: np.ndarray, flat: np.ndarray, offsets: np.ndarray, sample: np.ndarray, length: int) -> np.ndarray:
    """Which windows of each row occur in an earlier row of its group: (rows, offsets from the sample) of bools.

    Rows of a group stand in order of their places. A row's windows start 0 .. size - length
    bytes after its first byte, that is ``sample`` down to ``sample - (size - length)`` before its sample.
    """
    n, most = len(group), length - GRAM
    size = np.diff(offsets)
    at = offsets[:-1] + sample
    right = _gather(flat, at, np.arange(length), offsets[1:] - at)
    left = _gather(flat, at - 1, -np.arange(most), sample)
    new_group = np.concatenate(([True], group[1:] != group[:-1]))
    number = np.cumsum(new_group)
    by_right = np.lexsort((_names(_words(right)), number))
    by_left = np.lexsort((_names(_words(left)), number))
    shared_right, shared_left = _common(right, by_right), _common(left, by_left)
    for order, shared in ((by_right, shared_right), (by_left, shared_left)):
        shared[number[order] != np.concatenate(([0], number[order][:-1]))] = -1
    lowest = sample - (size - length)
    out = np.zeros((n, most + 1), bool)
    class_right, class_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(most + 1):
        rows = np.flatnonzero((lowest <= o) & (o <= sample))
        if not len(rows):
            continue
        class_right[by_right] = np.cumsum(shared_right < length - o)
        class_left[by_left] = np.cumsum(shared_left < o)
        key = class_right[rows] * (n + 1) + class_left[rows]
        first = np.unique(key, return_index=True)[1]
        again = np.ones(len(rows), bool)
        again[first] = False
        out[rows[again], o] = True
    return out


def _gather(flat: np.ndarray, at: np.ndarray, steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes at ``at + steps``, 0 after the first ``sizes`` of them."""
    index = at[:, None] + steps
    return np.where(np.arange(len(steps)) < sizes[:, None], flat[np.clip(index, 0, len(flat) - 1)], 0).astype(np.uint8)


def _words(matrix: np.ndarray) -> np.ndarray:
    """Rows as numbers of four bytes, largest first."""
    spare = -matrix.shape[1] % 4
    full = np.concatenate((matrix, np.zeros((len(matrix), spare), np.uint8)), axis=1)
    return np.ascontiguousarray(full).view(">u4").astype(np.int64)


def _spans(rows: dict[str, np.ndarray], again: np.ndarray) -> pa.RecordBatch:
    """place, tie, start, end of each run of repeated windows."""
    padded = np.zeros((len(again), again.shape[1] + 2), np.int8)
    padded[:, 1:-1] = again
    step = np.diff(padded, axis=1)
    row, low = np.nonzero(step == 1)
    high = np.nonzero(step == -1)[1] - 1
    position = rows["start"][row] + rows["sample"][row]
    return _span_batch(rows["place"][row], rows["tie"][row], position - high, position - low + rows["length"])


def _span_batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["place", "tie", "start", "end"])


_SPAN = "place long, tie long, start long, end long"


def _sorted_spans(rows: DataFrame, length: int) -> DataFrame:
    """Spans of the repeated windows of samples that come together by gram."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < _CHUNK_ROWS:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            gram = whole["gram"].to_numpy()
            cut = int(np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))[-1])
            if cut:
                yield from _chunk(whole.slice(0, cut), length)
            held = whole.slice(cut).to_batches()
        if held:
            yield from _chunk(pa.Table.from_batches(held), length)

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, _SPAN)


def _chunk(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    plain = table.filter(pc.is_null(table["context"]))
    if plain.num_rows:
        start = plain["start"].to_numpy()
        yield _span_batch(plain["place"].to_numpy(), plain["tie"].to_numpy(), start, start + plain["sample"].to_numpy() + length - 1)
    table = table.filter(pc.is_valid(table["context"]))
    if not table.num_rows:
        return
    names = ("gram", "place", "tie", "start", "sample")
    rows = {n: table[n].to_numpy().astype(np.int64) for n in names}
    order = np.lexsort((rows["start"], rows["tie"], rows["place"], rows["gram"]))
    same = np.zeros(len(order), bool)
    same[1:] = np.all([np.diff(rows[n][order]) == 0 for n in names[:4]], axis=0)  # the same text, read twice
    order = order[~same]
    content = table["context"].combine_chunks().take(pa.array(order))
    content = content.combine_chunks() if isinstance(content, pa.ChunkedArray) else content
    rows = {n: x[order] for n, x in rows.items()} | {"length": length}
    offsets = np.frombuffer(content.buffers()[1], np.int32)[content.offset:content.offset + len(content) + 1].astype(np.int64)
    flat = np.frombuffer(content.buffers()[2], np.uint8)
    yield _spans(rows, repeated_windows(rows["gram"], flat, offsets, rows["sample"], length))


def _hot_spans(rows: DataFrame, length: int) -> DataFrame:
    """The same for samples of frequent grams: every window is grouped by its own bytes."""
    rows = stored(rows, "hot-samples")  # read twice
    plain = rows.where("context IS NULL").select("place", "tie", "start", (F.col("start") + F.col("sample") + (length - 1)).alias("end"))
    windows = stored(
        rows.where("context IS NOT NULL").select(
            "place", "tie", "start", F.col("context"), F.explode(F.expr(f"sequence(0, octet_length(context) - {length})")).alias("o")
        ).select("place", "tie", (F.col("start") + F.col("o")).alias("start"), F.expr(f"substring(context, o + 1, {length})").alias("window")),
        "hot-windows",
    )
    firsts = stored(windows.groupBy("window").agg(F.min(F.struct("place", "tie", "start")).alias("first")), "first-windows")
    again = windows.join(firsts, "window").where(F.struct("place", "tie", "start") != F.col("first"))
    return plain.unionByName(again.select("place", "tie", "start", (F.col("start") + length).alias("end")))


def repeated_spans(texts: DataFrame, length: int = 100, hot_rows: int = 200_000) -> DataFrame:
    """place, tie, spans (start, end): the bytes to remove of each text that has any; spans may overlap."""
    counts = stored(gram_counts(texts, length).where("n > 1"), "repeated-grams")
    spark = texts.sparkSession
    repeated = spark.sparkContext.broadcast(Membership.of(counts.select("gram")))
    # At most one gram in hot_rows samples.
    hot = np.array([r["gram"] for r in counts.where(F.col("n") > hot_rows).select("gram").collect()], np.int64)
    spans = _sorted_spans(contexts(texts, length, repeated, hot, False), length)
    if len(hot):
        spans = spans.unionByName(_hot_spans(contexts(texts, length, repeated, hot, True), length))
    return spans.groupBy("place", "tie").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove_repeats(
    docs: DataFrame, length: int = 100, hot_rows: int = 200_000, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """id, n_bytes, spans (start, end; the maximal removed runs), kept (the remaining bytes, null where all stay), kept_sha256."""
    texts = _texts(docs, id_column, text_column)
    spans = stored(repeated_spans(texts, length, hot_rows), "repeated-spans")
    kind = texts.schema["id"].dataType.simpleString()
    affected = texts.sparkSession.sparkContext.broadcast(Membership.of(spans.select("tie")))

    def needed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that keep all bytes do not move."""
        for batch in batches:
            maybe = affected.value(batch.column(2).to_numpy())
            data = [(t.as_py() or "").encode() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), pa.array([len(d) for d in data], pa.int64()),
                pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()),
                pa.array([d if m else None for d, m in zip(data, maybe)], pa.binary()),
            ], names=["id", "place", "tie", "n_bytes", "whole_sha256", "data"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            runs, kept, digests = [], [], []
            for whole, data, found in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                merged = _merged(found)
                rest = None
                if merged:
                    body, at = data.as_py(), 0
                    parts = []
                    for start, end in merged:
                        parts.append(body[at:start])
                        at = end
                    rest = b"".join((*parts, body[at:]))
                runs.append([{"start": a, "end": b} for a, b in merged])
                kept.append(rest)
                digests.append(whole if rest is None else hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(runs, span), pa.array(kept, pa.binary()), pa.array(digests, pa.string())],
                names=["id", "n_bytes", "spans", "kept", "kept_sha256"],
            )

    moved = texts.mapInArrow(needed, f"id {kind}, place long, tie long, n_bytes long, whole_sha256 string, data binary")
    return moved.join(spans, ["place", "tie"], "left").select("id", "n_bytes", "whole_sha256", "data", "spans").mapInArrow(
        cut, f"id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, kept_sha256 string"
    )


def _merged(found: pa.ListScalar) -> list[tuple[int, int]]:
    if found.as_py() is None:
        return []
    values = found.values.flatten() if hasattr(found.values, "flatten") else []
    starts, ends = (v.to_numpy() for v in values)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(first)[1:] - 1, [len(starts) - 1]))
    return list(zip(starts[first].tolist(), reach[last].tolist()))
