"""SimHash near-duplicates by pivot distance tables (operator 7).

Every text gets a 64-bit fingerprint; two fingerprints link if they differ in at most `max_bits` bits; documents of
linked fingerprints share a component. Equal fingerprints collapse first, so a group of copies costs one row.

Fingerprints within three bits agree on two of five blocks of bits at least, so each goes into one group for each of
the ten pairs of blocks, and no link is lost. A group that holds more than CHUNK fingerprints is cut into chunks, and
each two chunks meet in a group of their own: no task gets an unbounded group. In a group the rows are sorted by their
distance to the first pivot (a reference fingerprint); only pairs whose distances to it differ by at most `max_bits`
are looked at, those whose distances to any other pivot differ by more are discarded (the triangle inequality: a
linked pair never is), and what survives is verified by counting bits. A group returns links to the least member of
each class found in it, at most one for each row, never all pairs; classes then meet by star contraction.

Defined cases: null texts and texts without words have fingerprint zero, which links as any other; a text of fewer
words than a shingle is one shingle; repeated rows are kept, each with its component; an empty table gives an empty
result; columns that aren't named are dropped by `fingerprints` and kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from turnstore.llm.common import materialise, without

SHINGLE_WORDS, MAX_BITS, SEED = 3, 3, 42
#: Blocks that the 64 bits are cut into. Beyond some 10^9 different fingerprints six keep groups small.
BLOCKS = 5
#: Fingerprints that meet in one group at most, but for the unevenness of a hash.
CHUNK = 4096
#: Shingles that are hashed together.
GROUP = 200_000


def pivots(n: int) -> np.ndarray:
    """n reference fingerprints, from a fixed sequence (the finalizer of splitmix64)."""
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


PIVOTS = pivots(16)


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Of UTF-8 text: bytes.lower changes A-Z only, bytes.split cuts at \\x20 and \\x09-\\x0D only."""
    words = text.lower().split()
    ones, n = np.zeros(64, np.int64), max(1, len(words) - shingle_words + 1) if words else 0
    for at in range(0, n, GROUP):
        part = words[at : at + min(GROUP, n - at) + shingle_words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle_words)))) if len(words) >= shingle_words else [b" ".join(words)]
        h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fp, the fingerprint as a signed long; narrow, no shuffle."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint((t.as_py() or "").encode("utf-8"), shingle_words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def masks(blocks: int, max_bits: int) -> list[int]:
    """The bits of each choice of blocks that must agree, as signed longs."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    bits = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [x - (1 << 64) if x >> 63 else x for x in (sum(c) for c in combinations(bits, blocks - max_bits))]


def classes(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index of each of n rows' class, given the links u, v."""
    label = np.arange(n)
    while True:
        # roots, as each label is one: a link goes only if both ends hang on the same one, which no later step parts
        a, b = label[u], label[v]
        live = a != b
        u, v, a, b = u[live], v[live], a[live], b[live]
        if not len(u):
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up


def links_within(group: np.ndarray, home: np.ndarray, pair: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows sorted by (group, distance to the first pivot), as fingerprints and the least of their class."""
    x = fp.view(np.uint64)
    table = np.bitwise_count(x[:, None] ^ PIVOTS).astype(np.int8)
    first = table[:, 0]
    us, vs = [], []
    i, step = np.arange(len(x)), 1
    while True:
        i = i[i + step < len(x)]
        j = i + step
        near = (group[i] == group[j]) & (first[j] - first[i] <= max_bits)
        i, j = i[near], j[near]
        if not len(i):
            break
        met = (pair[i] == 0) | (home[i] != home[j])
        a, b = i[met], j[met]
        for k in range(1, len(PIVOTS)):
            keep = abs(table[a, k] - table[b, k]) <= max_bits
            a, b = a[keep], b[keep]
            if not len(a):
                break
        linked = np.bitwise_count(x[a] ^ x[b]) <= max_bits
        us.append(a[linked])
        vs.append(b[linked])
        step += 1
    u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
    label = classes(len(x), u, v)
    out = np.flatnonzero(label != np.arange(len(x)))
    return fp[out], fp[label[out]]


def whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches that are sorted by their first column, cut anew so that no group of it is parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy(zero_copy_only=False)
        if held and held[-1].column(0)[-1].as_py() != g[0]:
            yield pa.concat_batches(held)
            held = []
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def links(different: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (a, b) of different fingerprints (column fp) that span the classes of linked ones; repeats are possible."""
    if blocks <= max_bits:
        raise ValueError("there must be more blocks than bits that may differ")
    keyed = different.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks(blocks, max_bits)))).alias("t", "key"))
    large = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    chunks = F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("int")
    met = keyed.join(large, ["t", "key"], "left").withColumn("c", chunks).withColumn("home", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    met = met.select("fp", "t", "key", "home", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    grouped = met.select(
        # two groups that share a hash only add pairs to verify
        F.xxhash64("t", "key", F.least("home", "other"), F.greatest("home", "other")).alias("g"),
        "fp",
        "home",
        (F.col("home") != F.col("other")).cast("int").alias("pair"),
        F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(PIVOTS[:1].view(np.int64)[0])))).alias("d"),
    )
    # in a group of two chunks (pair is 1) only rows of different chunks are compared

    def run(batches):
        for group in whole_groups(batches):
            yield found([group.column(n).to_numpy(zero_copy_only=False) for n in ("g", "home", "pair", "fp")])

    def found(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in links_within(*columns, max_bits)], ["a", "b"])

    return grouped.repartition("g").sortWithinPartitions("g", "d").mapInArrow(run, "a long, b long")


def contract(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root being the least node of its component.

    Alternating large-star and small-star steps, each a minimum by key and a join on that key; written to the shared
    folder after each round.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = materialise(edges.select(a, b).where("a != b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        down = large.join(low, F.col("a") == F.col("u")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(low.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(down).where("a != b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def components(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, id_col: str = "doc_id") -> DataFrame:
    """Add component_id, the least id reachable by links, to rows of (id_col, fp)."""
    prints = materialise(prints)
    least = prints.groupBy("fp").agg(F.min(id_col).alias("_least"))
    roots = contract(links(least.select("fp"), max_bits, blocks))
    roots = materialise(roots)
    # of the few fingerprints that have links, the least id of each component
    linked = least.join(roots.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("root").agg(F.min("_least").alias("_lowest"))
    linked = linked.join(lowest, "root").select("fp", "_lowest")
    whole = least.join(linked, "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("_lowest", "_least").alias("component_id"))
    # both sides are read as they lie, so that the join may split the rows of a fingerprint that very many texts share
    return prints.join(materialise(whole), F.col("fp") == F.col("_fp")).drop("_fp")


def one_of_each(docs: DataFrame, max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component the row of the least id stays, with all its columns."""
    found = components(fingerprints(docs, shingle_words, id_col, text_col), max_bits, id_col=id_col)
    return without(docs, found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), id_col)
