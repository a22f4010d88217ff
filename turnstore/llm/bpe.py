"""Byte pair encoding with forced boundaries (operator 4; operator 10 encodes with it too).

A merge can only ever build a token of the vocabulary. So two neighbouring bytes that stand side by side in no token
are never joined, whatever surrounds them: a cut between them is certain. Texts are cut at white space (the
pre-tokenizers never cross it in a way that depends on what lies further off), then at such byte pairs, and the
fragments are encoded one by one and concatenated. Fragments repeat, so each task keeps a bounded memo of them.

Defined cases: a null text counts as empty and has no tokens; strings of added special tokens inside a text become
their ids, as the library does by default; texts of any length are walked in one pass with memory in proportion to
the text; a unit with a code point that this Python's Unicode tables don't know goes to the library as a whole, whose
tables may be others; repeated rows get equal values; an empty table gives an empty result; columns other than the two
that are named are dropped.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstore.llm.common import text_or_empty

#: White space as the tokenizers' regular expressions have it (U+001C to U+001F aren't in it).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the pre-tokenizer's pattern that a ByteLevel with use_regex has.
BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

#: Entries that a task's memo of units may hold before it starts anew.
MEMO = 200_000
#: Characters of text whose units are encoded together; longer texts are walked in slices of this size.
GROUP = 2_000_000
#: Fragments of more symbols are merged with a heap, in n log n steps.
HEAP_FROM = 64
NONE = np.int64(1) << 30


@cache
def unassigned() -> re.Pattern:
    """Code points that this Python's Unicode tables have no entry for; the tables of other libraries may be older or newer."""
    points = [x for x in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(x)) == "Cn"]
    starts = [x for x, before in zip(points, [-1, *points]) if x != before + 1]
    ends = [x for x, after in zip(points, [*points[1:], -1]) if x != after - 1]
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends)) + "]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


class Encoder:
    """The vocabulary, merges and pre-tokenizer of a tokenizer file, ready to encode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], byte_symbols()
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec["pre_tokenizer"]]
        split = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        self.pattern = regex.compile(split.replace("\\s", WHITE) if split else BYTE_LEVEL)
        #: A unit that is encoded by itself: with its leading white space where the pre-tokenizer keeps that.
        self.units = re.compile(f"[^{WHITE}]+" if split else f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.edge = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
        self.first = np.array([self.vocab[s] for s in symbols], np.int64)
        self.last = np.array([self.vocab[s + self.suffix] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        keys = [self.vocab[a] << 16 | self.vocab[b] for a, b in pairs]
        self.rank = dict(zip(keys, range(len(keys))))
        self._index(np.array(keys, np.int64))
        self._cuts(symbols)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.path, self.library = path, None

    def _index(self, keys: np.ndarray) -> None:
        """A hash table with linear probing, from the two ids of a merge to its rank."""
        assert max(self.vocab.values()) < 1 << 16
        self.table, self.rank_of = np.full(1 << 19, -1, np.int64), np.zeros(1 << 19, np.int64)
        rank, slot = np.arange(len(keys)), self._slot(keys)
        while len(keys):
            free = self.table[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self.table[slot[put]], self.rank_of[slot[put]] = keys[put], rank[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, rank, slot = keys[left], rank[left], (slot[left] + 1) & (1 << 19) - 1

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 >> 9) & (1 << 19) - 1

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of ids, or NONE."""
        keys = a << 16 | b
        slot = self._slot(keys)
        there = self.table[slot]
        out = np.where(there == keys, self.rank_of[slot], NONE)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (1 << 19) - 1
            there = self.table[slot[open_]]
            hit = open_[there == keys[open_]]
            out[hit] = self.rank_of[slot[hit]]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return out

    def _cuts(self, symbols: list[str]) -> None:
        """joined[a << 8 | b]: a stands before b inside some token; in joined_last, in a token that ends a word with b."""
        byte, n = {s: b for b, s in enumerate(symbols)}, len(self.suffix)
        self.joined, self.joined_last = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        for token in self.vocab:
            ends = bool(n) and token.endswith(self.suffix)
            bs = [byte[c] for c in (token[:-n] if ends else token)]
            for i in range(1, len(bs)):
                (self.joined_last if ends and i == len(bs) - 1 else self.joined)[bs[i - 1] << 8 | bs[i]] = True
        if not n:
            self.joined_last = self.joined

    def words(self, unit: str) -> list[str]:
        """The pre-tokens of a unit, normalized."""
        if self.lower:
            if not unit.isascii():
                unit = unicodedata.normalize("NFC", unit)
            unit = "".join([c.lower() for c in unit]) if "Σ" in unit else unit.lower()
            # most units are letters, with or without a mark at the end; the pattern would part them just so
            if unit.isalpha():
                return [unit]
            if unit[-1] in ".,!?;:" and unit[:-1].isalpha():
                return [unit[:-1], unit[-1]]
        return self.pattern.findall(unit)

    def encode_units(self, units: list[str]) -> list[tuple[int, ...]]:
        """The ids of each unit: cut its words at forced boundaries, merge inside all fragments at once."""
        words, of, odd = [], [], {}
        for k, unit in enumerate(units):
            if not unit.isascii() and unassigned().search(unit):
                odd[k] = self.by_library(unit)
                continue
            found = self.words(unit)
            words += [w.encode("utf-8") for w in found]
            of += [k] * len(found)
        if not words:
            return [odd.get(k, ()) for k in range(len(units))]
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        final = np.zeros(len(data), bool)
        final[ends - 1] = True
        pair = data[:-1] << 8 | data[1:]
        cut = ~np.where(final[1:], self.joined_last[pair], self.joined[pair])
        cut |= final[:-1]
        fragment = np.concatenate(([0], np.cumsum(cut)))
        ids = np.where(final, self.last[data], self.first[data])
        ids, fragment = self.merge_all(ids, fragment)
        # each fragment belongs to one word, each word to one unit
        starts = np.concatenate(([0], np.flatnonzero(cut) + 1))
        word = np.searchsorted(ends, starts, side="right")
        unit = np.asarray(of, np.int64)[word][fragment]
        bounds = np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
        flat = ids.tolist()
        return [odd[k] if k in odd else tuple(flat[bounds[k] : bounds[k + 1]]) for k in range(len(units))]

    def by_library(self, unit: str) -> tuple[int, ...]:
        """The ids of a unit with code points that Python's tables don't know and the library's may."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return tuple(self.library.encode(unit, add_special_tokens=False).ids)

    def merge_all(self, ids: np.ndarray, fragment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In every fragment, the merge of lowest rank, leftmost first, until none is left; one a round in each."""
        done_ids, done_of = [], []
        long_ = np.bincount(fragment)[fragment] > HEAP_FROM
        if long_.any():
            many = np.unique(fragment[long_])
            bounds = zip(many.tolist(), np.searchsorted(fragment, many).tolist(), np.searchsorted(fragment, many, side="right").tolist())
            for k, start, end in bounds:
                made = self.merge_one(ids[start:end].tolist())
                done_ids.append(np.array(made, np.int64))
                done_of.append(np.full(len(made), k))
            ids, fragment = ids[~long_], fragment[~long_]
        rank = np.full(len(ids), NONE)
        same = np.flatnonzero(fragment[:-1] == fragment[1:])
        rank[same] = self.ranks(ids[same], ids[same + 1])
        while len(ids):
            n = len(ids)
            starts = np.concatenate(([0], np.flatnonzero(fragment[1:] != fragment[:-1]) + 1))
            best = np.minimum.reduceat(rank << 32 | np.arange(n), starts)
            goes_on = best < NONE << 32
            if not goes_on.all():
                keep = np.repeat(goes_on, np.diff(np.append(starts, n)))
                done_ids.append(ids[~keep])
                done_of.append(fragment[~keep])
                at = np.cumsum(keep) - 1
                ids, fragment, rank = ids[keep], fragment[keep], rank[keep]
                p = at[best[goes_on] & 0xFFFFFFFF]
            else:
                p = best & 0xFFFFFFFF
            if not len(p):
                break
            ids[p] = self.made[rank[p]]
            keep = np.ones(len(ids), bool)
            keep[p + 1] = False
            p = p - np.arange(len(p))  # places after the second halves have gone
            ids, fragment, rank = ids[keep], fragment[keep], rank[keep]
            new = np.concatenate((p, p[p > 0] - 1))
            new = new[new < len(ids) - 1]
            within = fragment[new] == fragment[new + 1]
            rank[p] = NONE
            new = new[within]
            rank[new] = self.ranks(ids[new], ids[new + 1])
        if not done_ids:
            return ids, fragment
        out, of = np.concatenate(done_ids), np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        return out[order], of[order]

    def merge_one(self, ids: list[int]) -> list[int]:
        """The same for one long fragment, with a heap of the pairs that can be merged."""
        n, made, rank = len(ids), self.made, self.rank

        def push(i: int, j: int) -> None:
            if (r := rank.get(ids[i] << 16 | ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        after, before, known = [*range(1, n + 1)], [*range(-1, n - 1)], np.array(ids)
        ranks = self.ranks(known[:-1], known[1:])
        heap = [(int(ranks[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(ranks < NONE).tolist()]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = int(made[r]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                push(i, k)
            if before[i] >= 0:
                push(before[i], i)
        return [x for x in ids if x >= 0]

    def slices(self, text: str) -> Iterator[str]:
        """A text in pieces of about GROUP characters, cut before white space."""
        at = 0
        while len(text) - at > GROUP and (m := self.edge.search(text, at + GROUP)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode_batch(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; units met for the first time are encoded in groups."""
        group: list[tuple[int, list[str], np.ndarray | None]] = []  # text, its units, or ids that are known
        size = 0
        for k, text in enumerate(texts):
            parts = self.specials.split(text) if self.specials and "<|" in text else [text]
            for i, part in enumerate(parts):
                if i % 2:
                    group.append((k, [], np.array([self.special[part]], np.int32)))
                else:
                    for piece in self.slices(part):
                        if size + len(piece) > GROUP and group:
                            yield from self._flush(group, k)
                            size = 0
                        group.append((k, self.units.findall(piece) if piece else [], None))
                        size += len(piece)
        yield from self._flush(group, None)

    def _flush(self, group: list, upto: int | None) -> Iterator[np.ndarray]:
        """The texts that end in this group; of the last, which goes on, the ids so far are kept in the group."""
        memo = self.memo
        new = list({u for _, units, _ in group for u in units if u not in memo})
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list({u for _, units, _ in group for u in units})
        memo.update(zip(new, self.encode_units(new)))
        held: list[np.ndarray] = []
        current = group[0][0] if group else None
        for k, units, known in group:
            if k != current:
                yield np.concatenate(held)
                held, current = [], k
            if known is not None:
                held.append(known)
            else:
                held.append(np.fromiter(chain.from_iterable(map(memo.__getitem__, units)), np.int32))
        group.clear()
        if current is not None:
            if current == upto:
                group.append((current, [], np.concatenate(held)))
            else:
                yield np.concatenate(held)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text])).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """As a tokenizer without a decoder: the tokens' strings, joined by spaces."""
        return " ".join([self.tokens[i] for i in ids])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file; one in each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_values: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256 and, with keep_values, the ids and the decoded text. Narrow:
    no shuffle, each partition streams through one Arrow batch at a time.
    """
    fields = f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    fields += ", ids array<int>, decoded string" if keep_values else ""

    def run(batches):
        enc = encoder(path)
        gc.set_threshold(1_000_000)  # the memo is many small tuples and no cycles
        number = [*map(str, range(max(enc.tokens) + 1))]
        for batch in batches:
            n, ids_sha, text_sha, kept, decoded = [], [], [], [], []
            for ids in enc.encode_batch(t.as_py() for t in batch.column(1)):
                ids = ids.tolist()
                tokens = enc.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([number[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(tokens.encode("utf-8")).hexdigest())
                if keep_values:
                    kept.append(ids)
                    decoded.append(tokens)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_values:
                arrays += [pa.array(kept, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, fields).withColumnRenamed("id", id_col)
