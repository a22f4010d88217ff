"""Token counts (operator 5): batch encoding in Arrow functions that return lengths only.

The tokenizer is a sentencepiece model. Its vocabulary is checked to hold no piece with a space after another
character, and so a text may be split before any run of spaces: no piece ever spans such a place. Texts of any length
are split there; the fragments that the task doesn't know yet go to the library in batches of about equal bytes.

Defined cases: a null text counts as empty, with no tokens; control strings such as `<s>` inside texts are ordinary
text, as is the library's default; repeated rows get equal counts; an empty table gives an empty result; other columns
pass through untouched, but columns called n_bytes, n_tokens or over_limit are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstore.llm.common import text_or_empty

#: Bytes of text whose fragments are looked up together, and of fragments in one call of the library.
GROUP_BYTES, BATCH_BYTES = 2_000_000, 250_000
#: Fragments that a task remembers.
MEMO = 400_000

SPACE = "▁"  # what the library writes for a space; a text may hold it too
UNITS = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
EDGE = re.compile(f"(?<=[^ {SPACE}])(?=[ {SPACE}])")


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8"))


class Counter:
    """Counts the tokens of texts with one model; one in each Python worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError(f"{path}: a piece spans the start of a word; texts can't be split there")
        self.memo: dict[str, int] = {}

    def learn(self, units: list[str]) -> None:
        """Each unit begins with a space, which the library puts before a text by itself."""
        size, batch = 0, []
        for u in units:
            batch.append(u)
            size += n_bytes(u)
            if size >= BATCH_BYTES:
                self._encode(batch)
                size, batch = 0, []
        self._encode(batch)

    def _encode(self, units: list[str]) -> None:
        if units:
            found = self.model.encode([u[1:] for u in units], num_threads=1)
            self.memo.update(zip(units, (len(x) or 1 for x in found)))  # a lone space is one token

    @staticmethod
    def units(text: str) -> Iterator[list[str]]:
        """The fragments of a text, each with a space in front, for slices of bounded size."""
        at, lead = 0, " "
        while at < len(text):
            m = EDGE.search(text, at + GROUP_BYTES) if len(text) - at > GROUP_BYTES else None
            end = m.start() if m else len(text)
            found = UNITS.findall(text, at, end)
            found[0] = lead + found[0]
            yield found
            at, lead = end, ""

    def count(self, texts: list[str]) -> list[int]:
        out, group, size = [0] * len(texts), [], 0
        for k, text in enumerate(texts):
            for found in self.units(text):
                group.append((k, found))
                size += n_bytes(text) if len(text) <= GROUP_BYTES else GROUP_BYTES
                if size >= GROUP_BYTES:
                    self._add(group, out)
                    group, size = [], 0
        self._add(group, out)
        return out

    def _add(self, group: list[tuple[int, list[str]]], out: list[int]) -> None:
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.learn([*{u for _, found in group for u in found if u not in self.memo}])
        get = self.memo.__getitem__
        for k, found in group:
            out[k] += sum(map(get, found))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_length(path: str):
    """An Arrow function from texts to their numbers of tokens."""

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(path)
        for texts in batches:
            yield pa.array(c.count(texts.to_pylist()), pa.int64())

    return lengths


def count_tokens(docs: DataFrame, path: str, limit: int, text_col: str = "text") -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (more than `limit` tokens) to the rows; narrow, no shuffle."""
    text = text_or_empty(F.col(text_col))
    counted = docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": token_length(path)(text)})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
