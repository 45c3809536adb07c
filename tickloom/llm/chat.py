"""Chat formatting at token level.

Role and text of a turn are encoded as segments of their own, so no token crosses a
boundary, and the turn marks are reserved ids outside the tokenizer's vocabulary. Marks
that occur in content are escaped (a backslash goes between ``<`` and ``|``; where
backslashes are there already, one more), so the formatted text is unambiguous too, and the
escape is undone on reading. The loss mask is the prefix sum of +1 at the first and -1
after the last content token of each assistant turn; token offsets in a conversation
are prefix sums of the segment lengths.

A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``. Turns are encoded where they lie; then
they are sorted within partitions by conversation and turn, and assembled as a stream, so a
conversation of any length needs the memory of one batch of turns.

Defined cases: null roles and texts are empty; line breaks in roles are escaped; null
turns come first and turns with equal numbers are ordered by role, then by text; a null conversation
id is a conversation; repeated rows are turns of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left in the result."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class ChatTokenizer:
    """A byte-level vocabulary with two reserved ids after it."""

    def __init__(self, ranks: bytes) -> None:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.start = max(table.values()) + 2
        self.end = self.start + 1

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: Iterable[int]) -> str:
        return self.encoding.decode_bytes(list(ids)).decode()


@lru_cache(maxsize=2)
def _tokenizer(ranks: bytes) -> ChatTokenizer:
    return ChatTokenizer(ranks)


def encode_segments(turns: DataFrame, ranks: bytes) -> DataFrame:
    """conv_id, turn, role, text, role_ids, text_ids: token ids of each turn's escaped segments."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(ranks)
        for batch in batches:
            roles, texts = ([v.as_py() or "" for v in batch.column(i)] for i in (2, 3))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()),
                pa.array([tokenizer.encode(_escape_role(r)) for r in roles], pa.list_(pa.int32())),
                pa.array([tokenizer.encode(escape(t)) for t in texts], pa.list_(pa.int32())),
            ], names=["conv_id", "turn", "role", "text", "role_ids", "text_ids"])

    columns = [F.col("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"]
    return turns.select(*columns).mapInArrow(
        run, f"conv_id {kind}, turn long, role string, text string, role_ids array<int>, text_ids array<int>"
    )


def format_turns(turns: DataFrame, vocabulary: str | None = None, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """conv_id, place (of the turn, from 0), offset (of its first token), ids, mask: the formatted conversations, a row a turn.

    Rows of a conversation lie together and in order within a partition.
    """
    ranks = open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    kind = turns.schema["conv_id"].dataType.simpleString()
    keys = ["conv_id", "turn", "role", "text"]
    ordered = encode_segments(turns, ranks).repartition("conv_id").sortWithinPartitions(*keys)
    learned = _escape_role(learned_role)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(ranks)
        newline, learned_ids = tokenizer.encode("\n"), np.array(tokenizer.encode(learned), np.int32)
        before: tuple | None = None
        place = offset = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            segments = _Segments(batch, tokenizer, newline)
            mask = segments.mask(learned_ids)
            places, offsets = [], []
            for conversation, size in zip(batch.column(0).to_pylist(), segments.sizes.tolist()):
                if before != (conversation,):
                    before, place, offset = (conversation,), 0, 0
                places.append(place)
                offsets.append(offset)
                place, offset = place + 1, offset + size
            bounds = pa.array(segments.bounds, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(places, pa.int64()), pa.array(offsets, pa.int64()),
                pa.ListArray.from_arrays(bounds, pa.array(segments.ids, pa.int32())),
                pa.ListArray.from_arrays(bounds, pa.array(mask, pa.int8())),
            ], names=["conv_id", "place", "offset", "ids", "mask"])

    return ordered.select("conv_id", "role_ids", "text_ids").mapInArrow(
        run, f"conv_id {kind}, place long, offset long, ids array<int>, mask array<byte>"
    )


class _Segments:
    """Turns of a batch spliced into one id array: start, role, line break, text, end, line break."""

    def __init__(self, batch: pa.RecordBatch, tokenizer: ChatTokenizer, newline: list[int]) -> None:
        self.roles, self.role_sizes = self._flat(batch.column(1))
        texts, self.text_sizes = self._flat(batch.column(2))
        n, gap = batch.num_rows, len(newline)
        self.sizes = self.role_sizes + self.text_sizes + 2 + 2 * gap
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))
        starts = self.bounds[:-1]
        self.text_starts = starts + 1 + self.role_sizes + gap
        ends = self.text_starts + self.text_sizes
        self.ids = np.empty(self.bounds[-1], np.int32)
        self.ids[starts], self.ids[ends] = tokenizer.start, tokenizer.end
        for i, token in enumerate(newline):
            self.ids[self.text_starts - gap + i] = token
            self.ids[ends + 1 + i] = token
        self.ids[self._inside(starts + 1, self.role_sizes)] = self.roles
        self.ids[self._inside(self.text_starts, self.text_sizes)] = texts
        self.rows = n

    @staticmethod
    def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()).astype(np.int64)

    @staticmethod
    def _inside(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places starts[i] .. starts[i] + sizes[i] - 1, one after another."""
        first = np.cumsum(sizes) - sizes
        return np.arange(sizes.sum()) + np.repeat(starts - first, sizes)

    def mask(self, learned: np.ndarray) -> np.ndarray:
        """1 on the content of turns whose role has these ids."""
        first = np.cumsum(self.role_sizes) - self.role_sizes
        chosen = self.role_sizes == len(learned)
        for i, token in enumerate(learned):
            chosen[chosen] = self.roles[first[chosen] + i] == token
        steps = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(steps, self.text_starts[chosen], 1)
        np.add.at(steps, (self.text_starts + self.text_sizes)[chosen], -1)
        return np.cumsum(steps)[:-1].astype(np.int8)


def read_turns(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """conv_id, role, text, learned (text under the loss mask), n_chars (of the formatted turn), read back from the ids."""
    ranks = open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(ranks)
        for batch in batches:
            out = [_read_turn(np.array(i, np.int32), np.array(m, np.int8), tokenizer) for i, m in zip(
                (v.values.to_numpy() for v in batch.column(1)), (v.values.to_numpy() for v in batch.column(2)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))],
                names=["conv_id", "role", "text", "learned", "n_chars"],
            )

    return formatted.select("conv_id", "ids", "mask").mapInArrow(
        run, f"conv_id {kind}, role string, text string, learned string, n_chars long"
    )


def _read_turn(ids: np.ndarray, mask: np.ndarray, tokenizer: ChatTokenizer) -> tuple[str, str, str | None, int]:
    end = int(np.flatnonzero(ids == tokenizer.end)[0])
    role, _, text = tokenizer.decode(ids[1:end].tolist()).partition("\n")
    tail = tokenizer.decode(ids[end + 1:].tolist())
    learned = unescape(tokenizer.decode(ids[mask == 1].tolist()))
    n_chars = len(START) + len(role) + 1 + len(text) + len(END) + len(tail)
    return _unescape_role(role), unescape(text), learned, n_chars


def conversation_digests(read: DataFrame) -> DataFrame:
    """One row a conversation; digests grow turn by turn, so no conversation is held whole.

    ``read`` must have the rows of a conversation together and in order, as ``read_turns`` gives them.
    """
    kind = read.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state: list = []

        def result(rows: list[list], like: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], like.type)] + [pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(types)], names=names
            )

        like = None
        for batch in batches:
            like, done = batch.column(0), []
            for conversation, role, text, learned, n in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (conversation,):
                    if now is not None:
                        done.append(_digest_row(now[0], state))
                    now, state = (conversation,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += n
            if done:
                yield result(done, like)
        if now is not None:
            yield result([_digest_row(now[0], state)], like)

    return read.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _digest_row(conversation, state: list) -> list:
    turns, turn_digest, chars, learned_digest, formatted = state
    return [conversation, turns, turn_digest.hexdigest(), chars, learned_digest.hexdigest(), formatted]
