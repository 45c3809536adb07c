"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints with at most ``d`` differing
bits differ in at most ``d`` bytes, so they share at least ``8 - d`` positional bytes: the
guaranteed minimum. A list for one positional byte would hold a 256th of all
fingerprints, and tallying from such lists forms pairs without bound. The lists are
therefore kept intersected: one list for each choice of ``8 - d`` positions and the
bytes there, so that whoever shares a list has reached the minimum. In a list at most ``256^d``
distinct fingerprints can be; each looks its neighbours up by their free bits, so
a list costs a fixed number of probes a member and forms no pairs that are not links.
Every link found is tallied (shared bytes) and verified (differing bits).

Fingerprints are compared once each, whatever the number of documents that have them;
components are found on distinct fingerprints.

Defined cases: null, empty and wordless texts have fingerprint zero and link like any
other; fewer words than a shingle give one shingle of them all; rows with equal ids
are separate members with one id; a null id is never chosen as component id unless a
component has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import connected_components
from tickloom.llm.shared import stored

POSITIONS = 8
SEED = 42
#: How many set bits each byte value adds to each of its eight bit positions.
_BITS = (np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1
#: Shingles are tallied in pieces of this many, so a long text needs no more memory.
_PIECE = 1 << 16


def fingerprint(text: str | None, shingle_words: int) -> int:
    """SimHash of the ASCII-lower-cased words' shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    last = ends[min(shingle_words, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_digest
    offsets = (np.arange(POSITIONS) * 256).astype(np.int64)
    ones = np.zeros((POSITIONS, 8), np.int64)
    for at in range(0, len(last), _PIECE):
        raw = b"".join([digest(flat[s:e], SEED) for s, e in zip(starts[at:at + _PIECE], last[at:at + _PIECE])])
        places = np.frombuffer(raw, np.uint8).reshape(-1, POSITIONS) + offsets
        tally = np.bincount(places.ravel(), minlength=POSITIONS * 256).reshape(POSITIONS, 256)
        ones += tally @ _BITS
    return int.from_bytes(np.packbits((2 * ones > len(last)).ravel()).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle_words: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, fingerprint (the 64 bits as a long) of every row."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle_words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["id", "fingerprint"])

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, fingerprint long"
    )


def index_lists(distinct: DataFrame, max_bits: int) -> DataFrame:
    """list (choice of positions), shared (the bytes there), members: lists with two members or more."""
    choices = list(combinations(range(POSITIONS), POSITIONS - max_bits))

    def mask(choice: tuple[int, ...]) -> int:
        value = sum(0xFF << 8 * (POSITIONS - 1 - p) for p in choice)
        return value - (1 << 64) if value >= 1 << 63 else value

    entries = F.array(*[
        F.struct(F.lit(n).alias("list"), F.col("fingerprint").bitwiseAND(F.lit(mask(c))).alias("shared")) for n, c in enumerate(choices)
    ])
    return (
        distinct.select("fingerprint", F.explode(entries).alias("entry"))
        .groupBy("entry.list", "entry.shared").agg(F.collect_list("fingerprint").alias("members"))
        .where(F.size("members") > 1)
    )


def _links(members: np.ndarray, free: np.ndarray, least_shared: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (smaller, larger) among fingerprints that differ in free bits alone.

    free: the masks of up to ``max_bits`` flipped free bits.
    """
    members = np.sort(members)
    if len(members) <= 64:
        a, b = np.triu_indices(len(members), 1)
        a, b = members[a], members[b]
    else:
        found = []
        for flips in np.array_split(free, max(1, len(free) * len(members) // 4_000_000)):
            wanted = members[:, None] ^ flips
            at = np.minimum(np.searchsorted(members, wanted), len(members) - 1)
            i, j = np.nonzero((members[at] == wanted) & (members[:, None] < wanted))
            found.append((members[i], wanted[i, j]))
        a, b = (np.concatenate(x) for x in zip(*found))
    differ = a ^ b
    shared = (differ[:, None].view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1)
    ok = (shared >= least_shared) & (np.bitwise_count(differ) <= max_bits)
    return a[ok], b[ok]


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """a, b: each pair of distinct fingerprints with at most ``max_bits`` differing bits, once."""
    choices = list(combinations(range(POSITIONS), POSITIONS - max_bits))
    least = POSITIONS - max_bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips: dict[int, np.ndarray] = {}
        for batch in batches:
            out_a, out_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for which, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                if which not in flips:
                    bits = [np.uint64(1 << 8 * (POSITIONS - 1 - p) + k) for p in range(POSITIONS) if p not in choices[which] for k in range(8)]
                    flips[which] = np.array([
                        np.bitwise_or.reduce(c) for n in range(1, max_bits + 1) for c in combinations(bits, n)
                    ], np.uint64)
                a, b = _links(members.values.to_numpy().view(np.uint64), flips[which], least, max_bits)
                # A pair in several lists is kept in the first of them alone.
                fresh = _first_list(a ^ b, choices) == which
                out_a.append(a[fresh])
                out_b.append(b[fresh])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"]
            )

    return index_lists(distinct, max_bits).select("list", "members").mapInArrow(run, "a long, b long")


def _first_list(differ: np.ndarray, choices: list[tuple[int, ...]]) -> np.ndarray:
    """The first choice of positions whose bytes are all equal."""
    equal = differ.astype(">u8")[:, None].view(np.uint8).reshape(-1, POSITIONS) == 0
    hit = np.stack([equal[:, list(c)].all(axis=1) for c in choices], axis=1)
    return hit.argmax(axis=1)


def near_copies(
    docs: DataFrame, shingle_words: int = 3, max_bits: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """id, fingerprint, component_id: one row per input row."""
    rows = stored(fingerprints(docs, shingle_words, id_column, text_column), "fingerprints")
    distinct = stored(rows.groupBy("fingerprint").agg(F.min("id").alias("node")), "distinct-fingerprints")
    edges = stored(links(distinct.select("fingerprint"), max_bits), "fingerprint-links")
    of = stored(connected_components(edges), "fingerprint-components")
    # Components are named by their smallest fingerprint first, then by their smallest id.
    joined = distinct.join(of, distinct["fingerprint"] == of["node"], "left").select(
        distinct["fingerprint"], distinct["node"].alias("id"), F.coalesce(of["component"], distinct["fingerprint"]).alias("component")
    )
    named = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    names = stored(joined.join(named, "component").select("fingerprint", "component_id"), "fingerprint-names")
    return rows.join(names, "fingerprint").select("id", "fingerprint", "component_id")


def one_of_each(
    docs: DataFrame, shingle_words: int = 3, max_bits: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Of each component the row with the smallest id, with the columns of ``docs``."""
    landed = stored(docs.select(F.struct("*").alias("document"), F.monotonically_increasing_id().alias("locator")), "documents")
    named = landed.select("locator", F.col(f"document.{id_column}").alias("id"), F.col(f"document.{text_column}").alias("text"))
    found = near_copies(named, shingle_words, max_bits, "locator", "text").select(F.col("id").alias("locator"), "component_id")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "locator")
    kept = (
        named.select("locator", "id").join(found, "locator").groupBy("component_id").agg(F.min(first).alias("first"))
        .select(F.col("first.locator").alias("locator"))
    )
    return landed.join(kept, "locator", "left_semi").select("document.*")


def hexadecimal(fingerprint_column: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint_column), 16, "0"))
