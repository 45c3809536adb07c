"""Token counts by the whole-token shortcut.

No piece of the vocabulary holds the mark of a space (U+2581) behind another character, so no merge crosses
the place before a run of such marks, and a text's count is the sum over its pre-tokens, each a run
of marks with what follows. ``Shortcut.prove`` shows once, on the driver, that the model is of this kind, and
which vocabulary strings the library encodes alone as one token; these strings, at
most the vocabulary, are broadcast. A task cuts its normalised texts into pre-tokens, counts
those that are proven strings as one each without any merge, and has the library merge only the rest, each
distinct one once while it is remembered. A map-only job: nothing is shuffled.

Defined cases: null texts are empty; an empty text has no tokens; white space, control and special strings in a
text are ordinary text, as the library has it; no begin or end token counts. Texts may be of any length and are cut in
segments of bounded size at such places. Repeated rows count each, ids may be null; an empty table gives an empty
result; other columns are ignored. Models whose vocabulary does not allow the cut raise.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import ship_module

ship_module(__name__)

SPACE = "▁"
#: Characters of normalised text cut at once; merged pre-tokens a task remembers, and the longest of them.
_SEGMENT, _KEPT, _LONGEST_KEPT = 1_000_000, 400_000, 64
_PRE_TOKEN = re.compile(f"{SPACE}+[^{SPACE}]*")
_BEFORE_RUN = re.compile(f"(?<!{SPACE}){SPACE}")


@dataclass(frozen=True)
class Shortcut:
    """A model file and the strings proven to be one token each."""

    model: bytes
    whole: frozenset[str]
    lone_space: int  # tokens of a single space mark

    @staticmethod
    def prove(model: bytes) -> Shortcut:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of the vocabulary goes on behind a space")
        if processor.normalize(" a  b ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}":
            raise ValueError("the model's normaliser drops white space or adds none before a text")
        ids = {p: i for i, p in enumerate(pieces) if p.startswith(SPACE) and p != SPACE}
        found = processor.encode([_text_of(p) for p in ids], num_threads=1)
        lone = len(processor.encode("a ")) - len(processor.encode("a"))
        whole = {p for (p, i), own in zip(ids.items(), found) if own == [i]}
        return Shortcut(model, frozenset(whole | ({SPACE} if lone == 1 else set())), lone)


def _text_of(pre_token: str) -> str:
    """The text the library normalises to a pre-token: it adds the first mark itself."""
    return pre_token[1:].replace(SPACE, " ")


class Counter:
    """Counts the tokens of texts in one task."""

    def __init__(self, shortcut: Shortcut) -> None:
        self.shortcut = shortcut
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=shortcut.model)
        self.merged: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.merged = dict.fromkeys(self.shortcut.whole, 1) | {SPACE: self.shortcut.lone_space}

    def __call__(self, texts: list[str]) -> list[int]:
        counts, held, size = [0] * len(texts), [], 0
        for row, text in enumerate(texts):
            for segment in self._segments(self.processor.normalize(text)):
                held.append((row, _PRE_TOKEN.findall(segment)))
                size += len(segment)
                if size > _SEGMENT:
                    self._add(held, counts)
                    held, size = [], 0
        self._add(held, counts)
        return counts

    def _segments(self, normal: str) -> Iterator[str]:
        start = 0
        while len(normal) - start > 2 * _SEGMENT:
            cut = _BEFORE_RUN.search(normal, start + _SEGMENT)
            if cut is None:
                break
            yield normal[start:cut.start()]
            start = cut.start()
        yield normal[start:] if start else normal

    def _add(self, held: list[tuple[int, list[str]]], counts: list[int]) -> None:
        rest = list(set(chain.from_iterable(own for _, own in held)).difference(self.merged))
        lengths = map(len, self.processor.encode([_text_of(p) for p in rest], num_threads=1)) if rest else ()
        self.merged.update(zip(rest, lengths))
        tokens_of = self.merged.__getitem__
        for row, own in held:
            counts[row] += sum(map(tokens_of, own))
        if len(self.merged) > _KEPT:
            self._forget()
        else:
            for p in rest:
                if len(p) > _LONGEST_KEPT:
                    del self.merged[p]


def count_tokens(docs: DataFrame, model_path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens: one row per input row."""
    with open(model_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        shortcut = docs.sparkSession.sparkContext.broadcast(Shortcut.prove(file.read()))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shortcut.value)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counter(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    size = F.octet_length(F.coalesce(text_column, F.lit(""))).cast("long")
    return docs.select(F.col(id_column).alias("id"), size.alias("n_bytes"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, n_bytes long, n_tokens long"
    )
