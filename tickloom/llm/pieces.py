"""SentencePiece encoding by suffix-array matching, and decoding.

A batch's texts are cut in chunks at places that no piece of the vocabulary crosses
(before white space that follows something else, and around line breaks), and a chunk not seen before in
parts where two characters meet that stand side by side in no piece; neither changes an encoding. Parts not
seen before are joined to one text and indexed by a suffix array, sorted by prefix
doubling to the length of the longest piece. A binary search of every piece at once gives
the range of its occurrences; each occurrence is an edge from its start to its end. The
edges, sorted by position, are relaxed from left to right.

For a BPE model the edge that relaxes is the one whose piece follows the last piece
before it as the merges would have it: a sequence of pieces is the encoding of its text
just where each piece and each neighbouring pair encodes to itself. So every position has one
best last piece, and the ids equal those of the merge procedure. Characters without a
piece become byte pieces.

Defined cases: null texts are empty and have no ids; the mark for a space (U+2581) in a text is
read back as a space, as the format has it; repeated rows are encoded each; an
empty table gives an empty result; texts may be of any length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Chunks of a generation (the last two are kept) and the size of the table of piece pairs a worker remembers; forgetting costs time alone.
_KEPT_CHUNKS, _KEPT_PAIRS = 120_000, 1 << 21
#: Longest run of texts, and of new parts, in characters, that is taken at once.
_BATCH_CHARS, _INDEX_CHARS = 1_000_000, 200_000
#: Ids whose bytes are put together at once.
_DECODED_IDS = 500_000


class PieceModel:
    """Pieces of a BPE model file, and what follows from them."""

    def __init__(self, model: bytes) -> None:
        self.processor = _processor(model)
        size = self.processor.get_piece_size()
        self.texts = [self.processor.id_to_piece(i) for i in range(size)]
        odd = [self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_unused(i) for i in range(size)]
        is_byte = [self.processor.is_byte(i) for i in range(size)]
        self.byte_ids = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if is_byte[i]}
        self.rank = {t: (self.processor.get_score(i), i) for i, t in enumerate(self.texts) if not odd[i] and not is_byte[i]}
        longer = [t for t in self.rank if len(t) > 1]
        # No longer piece holds these, and whether one goes on after white space that follows something else.
        self.alone = [c for c in "\n\t" if not any(c in t for t in longer)]
        self.through_space = any(SPACE in t.lstrip(SPACE) for t in longer)
        # Pieces that encode to themselves; only these can be part of an encoding.
        self.ids = np.array([i for t, (_, i) in self.rank.items() if self.merge(t) == [t]], np.int64)
        self.longest = max((len(self.texts[i]) for i in self.ids), default=1)
        self.codes = np.zeros((len(self.ids), self.longest), np.int64)
        for row, i in enumerate(self.ids):
            self.codes[row, :len(self.texts[i])] = [ord(c) for c in self.texts[i]]
        self.lengths = np.array([len(self.texts[i]) for i in self.ids], np.int64)
        # Characters of longer pieces are numbered from 1; which of them meet in a piece.
        longer = [self.texts[i] for i in self.ids if len(self.texts[i]) > 1]
        letters = sorted(set("".join(longer)))
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.meets = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        pairs = {t[k:k + 2] for t in longer for k in range(len(t) - 1)}
        self.meets[[self.number[ord(p[0])] for p in pairs], [self.number[ord(p[1])] for p in pairs]] = True

        self._trees()

    def _trees(self) -> None:
        """What the last merge of each usable piece joins, and every pair of pieces that makes a piece."""
        size = len(self.texts)
        # A piece's turn: single characters are there from the start, others come by falling score.
        order = sorted((t for t in self.rank if len(t) > 1), key=lambda t: (-self.rank[t][0], self.rank[t][1]))
        self.turn = np.full(size + 1, -1, np.int64)
        for turn, t in enumerate(order):
            self.turn[self.rank[t][1]] = turn
        self.first, self.second = np.arange(size + 1), np.arange(size + 1)
        # Whether all merges that make a piece come in the order of their turns.
        self.in_turn = np.ones(size + 1, bool)
        for i in sorted(self.ids.tolist(), key=lambda i: len(self.texts[i])):
            t = self.texts[i]
            if len(t) > 1:
                a, b = (self.rank[p][1] for p in self.merge(t, 2))
                self.first[i], self.second[i] = a, b
                self.in_turn[i] = max(self.turn[a], self.turn[b]) < self.turn[i] and self.in_turn[a] and self.in_turn[b]
        pairs = {}
        for t in order:
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a and b:
                    pairs[a[1] << 32 | b[1]] = self.turn[self.rank[t][1]]
        self.joins = np.array(sorted(pairs), np.int64)
        self.joined_turn = np.array([pairs[k] for k in self.joins.tolist()], np.int64)

    def side_by_side(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces encodes to itself, that is, whether no merge across the pair comes before it is whole.

        Read backwards: the piece that was made last is taken apart again, and the parts that then meet must not
        make a piece whose turn is before that of what was taken apart (left of two equal turns first). Pieces made out of
        turn, mostly runs of one character, go through the merges.
        """
        size = len(self.texts)
        a, b = np.minimum(left, size), np.minimum(right, size)
        fits, plain = np.ones(len(a), bool), self.in_turn[a] & self.in_turn[b]
        for i in np.flatnonzero(~plain).tolist():
            x, y = self.text(int(left[i])), self.text(int(right[i]))
            fits[i] = self.merge(x + y) == [x, y]
        open_ = np.flatnonzero(plain)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(open_):
            x, y = a[open_], b[open_]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
            across = (self.joins[at] == key) & (self.joined_turn[at] < limit[open_])
            fits[open_[across]] = False
            turn_a, turn_b = self.turn[x], self.turn[y]
            more = ~across & ((turn_a >= 0) | (turn_b >= 0))
            open_, x, y, turn_a, turn_b = open_[more], x[more], y[more], turn_a[more], turn_b[more]
            later = turn_a > turn_b
            limit[open_] = np.where(later, turn_a, turn_b + 1)
            a[open_], b[open_] = np.where(later, self.second[x], x), np.where(later, y, self.first[y])
        return fits

    def text(self, piece: int) -> str:
        return self.texts[piece] if piece < len(self.texts) else chr(piece - len(self.texts))

    def chunk_bounds(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Places in UTF-8 bytes that no piece crosses; ``texts`` are the bounds of texts."""
        bound = np.zeros(len(data) + 1, bool)
        bound[texts] = True
        if not self.through_space:
            first, middle, last = SPACE.encode()
            at = np.flatnonzero((data[:-2] == first) & (data[1:-1] == middle) & (data[2:] == last))
            behind = np.zeros(len(data) + 1, bool)
            behind[at + 3] = True
            bound[at[~behind[at]]] = True
        for c in self.alone:
            at = np.flatnonzero(data == ord(c))
            bound[at], bound[at + 1] = True, True
        return np.flatnonzero(bound)

    def merge(self, text: str, until: int = 1) -> list[str]:
        """The merge procedure on a short text, down to ``until`` parts: best pair first, leftmost of equals."""
        parts = list(text)
        while len(parts) > until:
            pairs = [(-self.rank[a + b][0], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]
            if not pairs:
                return parts
            _, i = min(pairs)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts


class Decoder:
    """The bytes of every id, one after another, and where they begin."""

    def __init__(self, model: bytes) -> None:
        bytes_of = [self._bytes(_processor(model), i) for i in range(_processor(model).get_piece_size())]
        self.flat = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.sizes = np.array([len(b) for b in bytes_of], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def _bytes(processor: sentencepiece.SentencePieceProcessor, i: int) -> bytes:
        if processor.is_byte(i):
            return bytes([int(processor.id_to_piece(i)[3:5], 16)])
        if processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i):
            return b""
        return processor.id_to_piece(i).replace(SPACE, " ").encode()

    def __call__(self, lists: pa.ListArray) -> list[str]:
        """Texts of lists of ids; the space the encoder puts before a text is taken off."""
        bounds = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy()[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        raw, ends, total = [], np.zeros(len(bounds), np.int64), 0
        for at in range(0, len(ids), _DECODED_IDS):
            own = ids[at:at + _DECODED_IDS]
            sizes = self.sizes[own]
            after = np.cumsum(sizes)
            raw.append(self.flat[np.arange(after[-1]) + np.repeat(self.begins[own] + sizes - after, sizes)].tobytes())
            inside = np.flatnonzero((bounds > at) & (bounds <= at + len(own)))
            ends[inside] = total + after[bounds[inside] - at - 1]
            total += int(after[-1])
        whole, ends = b"".join(raw), ends.tolist()
        texts = (whole[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:]))
        return [t[1:] if t.startswith(" ") else t for t in texts]


@lru_cache(maxsize=1)
def _processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


@lru_cache(maxsize=1)
def _decoder(model: bytes) -> Decoder:
    return Decoder(model)


class SuffixArray:
    """Suffixes of an integer text, ordered by their first ``depth`` symbols at least; 0 is smaller than all symbols of a pattern.

    As many symbols as fit in a number are ranked at once; then ranks of twice the length follow from pairs of ranks.
    """

    def __init__(self, codes: np.ndarray, depth: int) -> None:
        present = np.zeros(int(codes.max(initial=0)) + 1, bool)
        present[codes], present[0] = True, True
        self.dense = np.cumsum(present) - 1
        self.dense[~present] = -1
        bits = max(1, int(self.dense.max()).bit_length())
        self.bits, self.step = bits, 62 // bits
        # Zeros behind the text, so that every suffix has all its symbols.
        symbols = np.concatenate((self.dense[codes], np.zeros(max(depth, self.step), np.int64)))
        keys = np.zeros(len(symbols), np.int64)
        for at in range(self.step):
            keys[:len(symbols) - at] |= symbols[at:] << ((self.step - 1 - at) * bits)
        #: For each level its distinct keys; a suffix's rank is the place of its key.
        self.levels, known = [], self.step
        while True:
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
            self.levels.append(ordered[new])
            number = np.cumsum(new) - 1
            if known >= depth:
                break
            rank = np.empty(len(keys), np.int64)
            rank[order] = number
            keys = rank * len(rank)
            keys[:-known] += rank[known:]
            known *= 2
        self.order, self.size = order, len(order)
        self.first = np.append(np.flatnonzero(new), len(order))

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place in the order for each pattern, all by binary search at once."""
        blocks = 1 << (len(self.levels) - 1)
        patterns = np.where(np.arange(patterns.shape[1]) < lengths[:, None], patterns, 0)
        inside = patterns < len(self.dense)
        symbols = np.where(inside, self.dense[np.where(inside, patterns, 0)], -1)
        wide = np.zeros((len(patterns), blocks * self.step), np.int64)
        n = min(wide.shape[1], symbols.shape[1])
        wide[:, :n] = symbols[:, :n]
        absent = (wide < 0).any(axis=1)
        wide = np.where(wide < 0, 0, wide).reshape(len(patterns), blocks, self.step)
        shifts = np.arange(self.step - 1, -1, -1) * self.bits
        keys = (wide << shifts).sum(axis=2)
        own = np.clip(lengths[:, None] - np.arange(blocks) * self.step, 0, self.step)
        low, high = np.searchsorted(self.levels[0], keys), np.searchsorted(self.levels[0], keys + (1 << ((self.step - own) * self.bits)))
        size = self.step
        for level in self.levels[1:]:
            a, b, c, d = low[:, ::2], high[:, ::2], low[:, 1::2], high[:, 1::2]
            # The second half counts where the first is whole; no more than one key is equal to that.
            whole = (own[:, ::2] == size) & (a < b)
            low = np.searchsorted(level, a * self.size + np.where(whole, c, 0))
            high = np.searchsorted(level, np.where(whole, a * self.size + d, b * self.size))
            own, size = own[:, ::2] + own[:, 1::2], 2 * size
        low, high = self.first[low[:, 0]], self.first[high[:, 0]]
        return low, np.where(absent, low, high)


class Encoder:
    """Encodes texts; remembers chunks and pairs of pieces between batches."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.numbers = list(range(len(model.texts)))
        # A table with one place for each hash: a pair and its answer, until another pair takes the place.
        bits = _KEPT_PAIRS.bit_length() - 1
        self.pair_keys, self.pair_fits, self.pair_shift = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool), np.uint64(64 - bits)

    def forget(self) -> None:
        """Drop what was kept between batches, but for the pairs."""
        self.known, self.older, self.parts = {}, {}, {}

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.lists(texts).to_pylist()

    def lists(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        if len(self.known) > _KEPT_CHUNKS:
            self.known, self.older = {}, self.known
        if len(self.parts) > _KEPT_CHUNKS:
            self.parts = {}
        whole = [self.model.processor.normalize(t).encode() for t in texts]
        data = b"".join(whole)
        ends = np.cumsum([0, *map(len, whole)])
        del whole
        bounds = self.model.chunk_bounds(np.frombuffer(data, np.uint8), ends)
        chunks = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        distinct, index = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
        fresh = set(distinct).difference(self.known)
        again = fresh.intersection(self.older)
        self.known.update((c, self.older[c]) for c in again)
        fresh = list(fresh - again)
        if fresh:
            self.known.update(self._by_parts(fresh))
        found = list(map(self.known.__getitem__, distinct))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, sizes.sum())
        own = sizes[index]
        after = np.concatenate(([0], np.cumsum(own)))
        ids = flat[np.arange(after[-1]) + np.repeat((np.cumsum(sizes) - sizes)[index] - after[:-1], own)]
        offsets = after[np.searchsorted(bounds, ends)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))

    def _by_parts(self, chunks: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Encodings of chunks, from those of their parts."""
        joined = "\n".join(chunks)
        number = self.model.number[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        cut = ~self.model.meets[number[:-1], number[1:]]
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1) - 1
        # The line break between two chunks is a part of neither.
        cut[ends[:-1] - 1], cut[ends[:-1]] = True, True
        bounds = np.concatenate(([0], np.flatnonzero(cut) + 1, [len(joined)])).tolist()
        parts = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        fresh = list(set(parts).difference(self.parts))
        start = size = 0
        for i, part in enumerate(fresh):
            if i > start and size + len(part) > _INDEX_CHARS:
                self.parts.update(zip(fresh[start:i], self._encode(fresh[start:i])))
                start, size = i, 0
            size += len(part) + 1
        if fresh:
            self.parts.update(zip(fresh[start:], self._encode(fresh[start:])))
        last = np.searchsorted(bounds, ends).tolist()
        first = 0
        for chunk, after in zip(chunks, last):
            own = parts[first:after]
            yield chunk, self.parts[own[0]] if len(own) == 1 else tuple(chain.from_iterable(map(self.parts.__getitem__, own)))
            first = after + 1

    def _encode(self, chunks: list[str]) -> list[tuple[int, ...]]:
        model = self.model
        # One symbol between chunks, which no piece holds.
        joined = "\0".join(chunks) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        sizes = np.array([len(c) for c in chunks], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        codes[begins + sizes] = 0
        index = SuffixArray(codes, model.longest)
        low, high = index.ranges(model.codes + 1, model.lengths)
        counts = high - low
        first = np.cumsum(counts) - counts
        starts = index.order[np.arange(counts.sum()) + np.repeat(low - first, counts)]
        row = np.repeat(np.arange(len(counts)), counts)
        ends, piece = starts + model.lengths[row], model.ids[row]
        # A character without a piece of its own is an edge as well: its id is past the vocabulary.
        size = len(model.texts)
        alone = np.ones(len(codes), bool)
        alone[begins + sizes] = False
        alone[starts[model.lengths[row] == 1]] = False
        bare = np.flatnonzero(alone)
        starts, ends = np.concatenate((starts, bare)), np.concatenate((ends, bare + 1))
        piece = np.concatenate((piece, size + codes[bare] - 1))
        chosen = self._relax(starts, ends, piece, begins, sizes, len(codes))
        return self._read_back(chosen, starts, piece, begins, sizes)

    def _relax(self, starts, ends, piece, begins, sizes, n: int) -> np.ndarray:
        """For each position the edge that ends there and fits what is before it; -1 where none.

        Chunks advance together: edges are taken by their end's distance from the chunk's begin.
        """
        chunk_begin = np.repeat(begins, sizes + 1)
        distance = ends - chunk_begin[starts]
        # Few distinct distances: small numbers are sorted by counting.
        order = np.argsort(distance.astype(np.uint16) if distance.max(initial=0) < 1 << 16 else distance, kind="stable")
        cuts = np.searchsorted(distance[order], np.arange(1, (distance.max() if len(order) else 0) + 2))
        last = np.full(n + 1, -1, np.int64)
        edge = np.full(n + 1, -1, np.int64)
        at_begin = starts == chunk_begin[starts]
        for a, b in zip(cuts, cuts[1:]):
            now = order[a:b]
            before = last[starts[now]]
            fits = at_begin[now].copy()
            inner = np.flatnonzero(~fits & (before >= 0))
            fits[inner] = self._fit(before[inner], piece[now[inner]])
            now = now[fits]
            # An end that is also the next chunk's begin cannot be: a separator lies between.
            last[ends[now]], edge[ends[now]] = piece[now], now
        return edge

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces encodes to itself."""
        keys = left << 32 | right
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.pair_shift).astype(np.int64)
        fits = self.pair_fits[at]
        missed = np.flatnonzero(self.pair_keys[at] != keys)
        if len(missed):
            fresh, back = np.unique(keys[missed], return_inverse=True)
            answers = self.model.side_by_side(fresh >> 32, fresh & 0xFFFFFFFF)
            fits[missed] = answers[back]
            # Of several new pairs with one place one is kept.
            place, own = np.unique(at[missed], return_index=True)
            self.pair_keys[place], self.pair_fits[place] = fresh[back[own]], answers[back[own]]
        return fits

    def _read_back(self, edge, starts, piece, begins, sizes) -> list[tuple[int, ...]]:
        """Ids of every chunk, from its end back to its begin, all chunks a step at a time."""
        found_chunk, found_piece = [], []
        chunk, at = np.arange(len(begins)), begins + sizes
        while len(chunk):
            best = edge[at]
            found_chunk.append(chunk)
            found_piece.append(piece[best])
            at = starts[best]
            more = at > begins[chunk]
            chunk, at = chunk[more], at[more]
        chunks, pieces = np.concatenate(found_chunk[::-1]), np.concatenate(found_piece[::-1])
        order = np.argsort(chunks, kind="stable")
        counts = np.bincount(chunks, minlength=len(begins))
        ordered = pieces[order]
        size, byte_ids = len(self.model.texts), self.model.byte_ids
        bounds = np.concatenate(([0], np.cumsum(counts)))
        bare = np.unique(np.searchsorted(bounds, np.flatnonzero(ordered >= size), "right") - 1)
        own_ids = {
            i: [b for p in ordered[bounds[i]:bounds[i + 1]].tolist()
                for b in ([p] if p < size else [byte_ids.get(c, self.model.processor.unk_id()) for c in chr(p - size).encode()])]
            for i in bare.tolist()
        }
        # One object for each id.
        ids = list(map(self.numbers.__getitem__, np.minimum(ordered, size - 1).tolist()))
        bounds = bounds.tolist()
        out = [tuple(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
        for i, own in own_ids.items():
            out[i] = tuple(map(self.numbers.__getitem__, own))
        return out


@lru_cache(maxsize=1)
def _encoder(model: bytes) -> Encoder:
    """One for all tasks of a worker, which go on with the pairs the last has found."""
    return Encoder(PieceModel(model))


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def _read(path: str | None) -> bytes:
    with open(path or default_model(), "rb") as file:
        return file.read()


def encode(docs: DataFrame, model_path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text, ids: one row per input row."""
    kind, model = docs.schema[id_column].dataType.simpleString(), _read(model_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            for part in _parts(batch):
                texts = [v.as_py() or "" for v in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), encoder.lists(texts)], names=["id", "text", "ids"]
                )
        encoder.forget()  # the worker may go on with another stage

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, text string, ids array<int>"
    )


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of bounded size; a long text is a slice of its own."""
    start = size = 0
    for row, text in enumerate(batch.column(1)):
        own = len(text.as_py() or "")
        if row > start and size + own > _BATCH_CHARS:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += own
    if start < batch.num_rows:
        yield batch.slice(start)


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """id, text, ids, decoded."""
    kind, model = encoded.schema["id"].dataType.simpleString(), _read(model_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = _decoder(model)
        for batch in batches:
            for part in _parts(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text_of(part.column(2)), pa.string())], names=["id", "text", "ids", "decoded"])

    return encoded.select("id", "text", "ids").mapInArrow(run, f"id {kind}, text string, ids array<int>, decoded string")
