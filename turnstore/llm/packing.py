"""Best-fit packing (operator 10).

Pieces of at most `capacity` tokens go into as few sequences of `capacity` as can be had: a configuration linear
program over the histogram of lengths (at most `capacity` rows, whatever the size of the input), solved by
multiplicative weights with a knapsack dynamic program as pricing, then rounded down; what rounding leaves, a number
of pieces that is bounded by the number of configurations, goes by best fit. The driver sees the histogram and the
plan only. Pieces find their places by their rank among the pieces of their length, from two-level prefix sums.

Defined cases: a null text counts as empty and is one piece (the end token); repeated rows are pieces of their own;
an empty table gives an empty result; documents longer than the capacity are cut so that only the first piece may be
shorter than the capacity; texts of any length, and runs of one character of any length, are encoded as the library
encodes the whole text; strings of added special tokens inside a text become their ids, as is the library's default.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter, defaultdict
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstore.llm.bpe import BYTE_LEVEL, WHITE, byte_symbols
from turnstore.llm.common import materialise, text_or_empty

CAPACITY, END_ID = 1024, 2
#: Rows of a bucket in which pieces are numbered.
BUCKET_ROWS = 20_000
#: Rounds of the program; share of a configuration's scarcest length that a step covers; how fast a length that is
#: covered loses worth; how far from the best a configuration that is used may be; how much more than its share of a
#: sequence a long piece is worth, as it is harder to place.
ROUNDS, STEP, ETA, TOLERANCE, BIAS = 400, 0.5, 0.1, 0.03, 1.0

#: Characters of a word or of white space from which on its unit, a word with the white space before it, is long.
LONG = 1000
#: A byte-level pre-tokenizer parts units without a look further off, so texts may be cut around long ones.
LONG_UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]{{{LONG},}}|[{WHITE}]{{{LONG},}}[^{WHITE}]*")
RUN = re.compile(f"[^{WHITE}]{{{LONG}}}|[{WHITE}]{{{LONG}}}")


class Encoder:
    """The ids of texts as the tokenizers library gives them.

    The same vocabulary in tiktoken is four times as fast, and its tables part all code points alike, but it fails on
    long runs of one kind of character. So long units go to the tokenizers library itself, and what lies between them
    to the fast one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {s: b for b, s in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=self.special)
        self.allowed = set(self.special)

    @cached_property
    def library(self):
        """Read when the first long unit comes: most tasks don't need it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def encode(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for start, end in (m.span() for m in LONG_UNITS.finditer(text)) if RUN.search(text) else ():
            if start > at:
                parts.append(self.fast.encode_to_numpy(text[at:start], allowed_special=self.allowed, disallowed_special=()))
            parts.append(np.array(self.library.encode(text[start:end], add_special_tokens=False).ids, np.uint32))
            at = end
        if at < len(text) or not parts:
            parts.append(self.fast.encode_to_numpy(text[at:] if at else text, allowed_special=self.allowed, disallowed_special=()))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file; one in each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n tokens; only the first may be shorter than the capacity."""
    return [0, *range((n - 1) % capacity + 1, n, capacity)] if n > capacity else [0]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every whole text, ended by END_ID."""
    fields = f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.append(enc.encode(text.as_py()), np.uint32(END_ID))
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                at = cuts(len(ids), capacity)
                for p, (a, b) in enumerate(zip(at, [*at[1:], len(ids)])):
                    of.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def knapsack(worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity, the greatest worth of lengths (repeats allowed) that fit, and the length to take first."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(worth > 0)
    values, upto = worth[lengths], np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        total = values[: upto[c]] + best[c - lengths[: upto[c]]]
        k = int(total.argmax()) if len(total) else -1
        if k >= 0 and total[k] > best[c - 1]:
            best[c], took[c] = total[k], lengths[k]
        else:
            best[c] = best[c - 1]
    return best, took


def filled(first: int, took: np.ndarray, capacity: int) -> Counter:
    """The configuration of greatest worth among those that hold the length `first`."""
    out, c = Counter({first: 1}), capacity - first
    while c > 0:
        if took[c]:
            out[int(took[c])] += 1
        c -= int(took[c]) or 1
    return out


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> dict[tuple, float]:
    """A fractional cover of the counts by configurations, by multiplicative weights.

    A length is worth its share of a sequence, less as more of it is covered. In each round the knapsack prices all
    configurations; for every length the best that holds it is used if its worth is within TOLERANCE of the best of
    all, for the share STEP of what is left of its scarcest length (one sequence at least). The rounds end when
    everything is covered.
    """
    need = np.zeros(capacity + 1)
    for length, n in counts.items():
        need[length] = n
    left, size = need.copy(), np.arange(capacity + 1) / capacity * (1 + BIAS * np.arange(capacity + 1) / capacity)
    found: dict[tuple, float] = defaultdict(float)
    for _ in range(ROUNDS):
        live = left >= 1 - 1e-9
        if not live.any():
            break
        worth = np.where(live, size * np.exp(-ETA * (1 - left / np.maximum(need, 1))), 0)
        best, took = knapsack(worth, capacity)
        for first in np.flatnonzero(live)[::-1].tolist():
            if worth[first] + best[capacity - first] >= (1 - TOLERANCE) * best[capacity]:
                config = filled(first, took, capacity)
                most = min(left[a] / m for a, m in config.items())
                if most >= 1:
                    x = max(1.0, STEP * most)
                    found[tuple(sorted(config.items()))] += x
                    for a, m in config.items():
                        left[a] -= x * m
    return found


def best_fit(counts: Counter, capacity: int, bins: Counter | None = None) -> Counter:
    """Best fit, longest first: how often each configuration (a sorted tuple) is used. Equal bins move together."""
    free: list[Counter] = [Counter() for _ in range(capacity + 1)]
    for config, n in (bins or {}).items():
        free[capacity - sum(a * m for a, m in config)][config] += n
    free[capacity] = Counter()
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = next((r for r in range(length, capacity) if free[r]), capacity)
            if room == capacity:
                m, each = capacity // length, Counter({(): -(-n // (capacity // length))})
            else:
                m, each = room // length, free[room]
            config = min(each)
            k = min(each[config], -(-n // m))
            full, rest = divmod(n, m) if k * m > n else (k, 0)
            each[config] -= k
            if not each[config]:
                del each[config]
            for copies, times in ((m, full), (rest, 1 if rest else 0)):
                if times:
                    made = tuple(sorted((Counter(dict(config)) + Counter({length: copies})).items()))
                    free[room - copies * length][made] += times
                    n -= copies * times
    return sum(free, Counter())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations and how many sequences have each; together they hold exactly the counts.

    The program's solution is rounded down; best fit puts the rest beside what the configurations hold.
    """
    used = Counter({config: int(x + 1e-9) for config, x in solve(counts, capacity).items()})
    rest = Counter(counts)
    for config, n in used.items():
        for a, m in config:
            rest[a] -= n * m
    return sorted((+best_fit(+rest, capacity, +used)).items())


def slots(configs: list, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """For each length of each configuration: length, first and last rank, first sequence, copies in each, offset."""
    out, sequence, ranks = [], 0, Counter()
    for config, n in configs:
        offset = 0
        for length, m in config:
            out.append((length, ranks[length], ranks[length] + n * m - 1, sequence, m, offset))
            ranks[length] += n * m
            offset += length * m
        sequence += n
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` of at most the capacity."""
    spark = cut.sparkSession
    cut = materialise(cut.withColumn("_row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    buckets = max(16, sum(counts.values()) // BUCKET_ROWS)
    # the low bits of _row number the rows of a partition, so neighbours go to different buckets
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    sums = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = cut.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_row")))
    ranked = ranked.join(sums, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_k") - 1)
    # bounded: a few rows for each configuration, at most ROUNDS for each length, and those that rounding has left
    places = spark.createDataFrame(slots(plan(counts, capacity), capacity), "_length long, _first long, _last long, _sequence long, _copies int, _offset long")
    at = F.col("_rank") - F.col("_first")
    return (
        ranked.join(F.broadcast(places), (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last")))
        .withColumn("sequence_id", F.col("_sequence") + F.floor(at / F.col("_copies")))
        .withColumn("offset", F.col("_offset") + F.pmod(at, F.col("_copies")) * F.col("length"))
        .drop("_row", "_bucket", "_k", "_before", "_rank", "_length", "_first", "_last", "_sequence", "_copies", "_offset")
    )
