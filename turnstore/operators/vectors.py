"""The document store's algebra, DataFrame to DataFrame, and a store of versioned snapshots on it."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstore.functions.vectors import distance_to
from turnstore.operators.where import compile_where
from turnstore.schemas import INDEXED, VECTORS

#: Numbers and rows of a block of vectors; queries that are compared with one at once.
BLOCK, BLOCK_ROWS, BLOCK_QUERIES = 1 << 18, 2048, 256
#: Bytes of query vectors that are sent to all tasks at most; more of them meet the rows by a product of blocks.
SENT_BYTES = 64 << 20
FORMAT_VERSION = 1


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row that comes last."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def upsert(base: DataFrame, new: DataFrame, order: str, key: str = "id") -> DataFrame:
    """base with the rows of new in place of those of the same key; of equal keys in new the last by `order` counts."""
    fresh = last_of_each(new, key, order).select(*base.columns)
    return base.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def delete(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """base without the given keys; unknown ones don't matter."""
    return base.join(ids.select(key), key, "left_anti")


def update_metadata(base: DataFrame, ids: DataFrame, patch: dict, key: str = "id") -> DataFrame:
    """A shallow merge of patch into the metadata of the given keys."""
    chosen = base.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.col("_hit").isNotNull()
    columns = {k: F.when(hit, F.lit(v).cast(INDEXED[k])).otherwise(F.col(k)) for k, v in patch.items() if k in INDEXED}
    extra = {k: json.dumps(v, ensure_ascii=False) for k, v in patch.items() if k not in INDEXED}
    if extra:
        old = F.coalesce("extras", F.create_map().cast("map<string,string>"))
        kept = F.map_filter(old, lambda k, _: ~k.isin(*extra))
        columns["extras"] = F.when(hit, F.map_concat(kept, F.create_map(*(F.lit(x) for kv in extra.items() for x in kv)))).otherwise(F.col("extras"))
    return chosen.withColumns(columns).select(*base.columns)


def metadata(df: DataFrame) -> DataFrame:
    """Add `metadata`: a map from key to JSON value of what a document has."""
    pairs = F.create_map(*(x for k in INDEXED for x in (F.lit(k), F.when(F.col(k).isNotNull(), F.to_json(F.struct(F.col(k).alias("v")))))))
    plain = F.transform_values(F.map_filter(pairs, lambda _, v: v.isNotNull()), lambda _, v: F.regexp_extract(v, r'(?s)^\{"v":(.*)\}$', 1))
    return df.withColumn("metadata", F.map_concat(plain, F.coalesce("extras", F.create_map().cast("map<string,string>"))))


def query(base: DataFrame, vector: Sequence[float], limit: int, where: dict | None = None, key: str = "id") -> DataFrame:
    """rank, key and cosine distance of the nearest rows; ties by key. A top-k in each partition, then one of those."""
    found = base.where(compile_where(where)).select(key, distance_to(F.col("embedding"), vector).alias("distance"))
    top = found.orderBy("distance", key).limit(max(limit, 0))
    return top.select(F.row_number().over(Window.orderBy("distance", key)).alias("rank"), key, "distance")  # `limit` rows


def blocks(rows: DataFrame, key: str, vector: str, names: tuple[str, str]) -> DataFrame:
    """The rows as blocks of at most BLOCK numbers: a list of keys and one of vectors, both named by `names`; no shuffle."""
    rows = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            at = 0
            longest = pc.max(pc.list_value_length(batch.column(1))).as_py() or 1
            while at < batch.num_rows:
                part = batch.slice(at, max(1, min(BLOCK_ROWS, BLOCK // longest)))
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in (0, 1)], list(names))

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"{names[0]} array<{kind}>, {names[1]} array<array<double>>")


def matrices(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of the vectors of each length; those that are null or hold nulls have length -1."""
    sizes, numbers = pc.list_value_length(column), column.flatten()
    if len(column) and not column.null_count and not numbers.null_count and (n := sizes[0].as_py()) == pc.min(sizes).as_py() == pc.max(sizes).as_py():
        return {n: (np.arange(len(column)), numbers.to_numpy().reshape(len(column), n))}
    at: dict[int, list[int]] = {}
    vectors = column.to_pylist()
    for k, v in enumerate(vectors):
        at.setdefault(-1 if v is None or None in v else len(v), []).append(k)
    return {n: (np.array(ks), np.array([vectors[k] for k in ks], np.float64).reshape(len(ks), n) if n >= 0 else np.zeros((len(ks), 0))) for n, ks in at.items()}


def different(x: np.ndarray, place: np.ndarray, limit: int) -> np.ndarray:
    """Positions in x without those that `limit` equal vectors precede: no query needs them."""
    order = np.argsort(place, kind="stable")
    _, same = np.unique(x[order], axis=0, return_inverse=True)
    same = same.reshape(-1)
    by = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(same[by]) != 0])
    nth = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    return order[by[nth < limit]]


def nearest_within(x: np.ndarray, place: np.ndarray, q: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in q and x, and distances, of the `limit` nearest rows of x to each row of q; ties by place.

    One matrix product, whose last digits depend on a row's position, finds the candidates; their distances are then
    summed in the order of the numbers, so that equal vectors are equally far.
    """
    with np.errstate(all="ignore"):
        near = np.nan_to_num(q @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        wide = np.nan_to_num(1e-14 * (x.shape[1] + 1) * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max()), nan=np.inf)
        least = np.partition(near, len(x) - limit, axis=1)[:, len(x) - limit] if limit < len(x) else np.full(len(q), -np.inf)
        i, j = np.nonzero(near >= (least - wide)[:, None]) if limit < len(x) else np.nonzero(np.ones(near.shape, bool))
        d = np.zeros(len(i))
        for k in range(x.shape[1]):
            d += x[j, k] * q[i, k]
        d = 1.0 - d
    best = np.lexsort((place[j], d, i))
    i, j, d = i[best], j[best], d[best]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < limit
    return i[keep], j[keep], d[keep]


def query_batch(base: DataFrame, queries: DataFrame, limit: int, key: str = "id", query_key: str = "query_id") -> DataFrame:
    """The nearest rows of each query vector (query_key, vector), all rows against all; ties by key.

    Blocks of rows meet blocks of queries (a stated set, sent to all tasks if it is measured to be small); of each two the nearest of each query stay, and those are merged by query.
    A row without a vector of the query's length has the distance null, which comes first.
    """
    if limit < 1:
        return base.crossJoin(queries).select(query_key, key, F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).where("false")
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, query_key), (base, key))]
    size = queries.agg(F.coalesce(F.sum(8 * F.size("vector") + 64), F.lit(0))).first()[0]
    wanted = blocks(queries.repartition(query_key), query_key, "vector", ("qs", "us"))
    pairs = blocks(base, key, "embedding", ("ks", "vs")).crossJoin(F.broadcast(wanted) if size <= SENT_BYTES else wanted)

    def found(ks: pa.Array, vs: pa.ListArray, qs: pa.Array, us: pa.ListArray):
        place = np.empty(len(ks), np.int64)
        place[pc.sort_indices(ks, null_placement="at_start").to_numpy()] = np.arange(len(ks))
        held = matrices(vs)
        for n, (at, q) in matrices(us).items():
            rest = np.concatenate([x[0] for m, x in held.items() if m != n or n < 0] or [np.zeros(0, np.int64)])
            if len(rest):
                rest = rest[np.argsort(place[rest])[:limit]]
                yield np.repeat(at, len(rest)), np.tile(rest, len(at)), np.full(len(at) * len(rest), np.nan), True
            if n >= 0 and n in held:
                rows, x = held[n]
                few = different(x, place[rows], limit)
                rows, x = rows[few], x[few]
                for k in range(0, len(at), BLOCK_QUERIES):
                    i, j, d = nearest_within(x, place[rows], q[k : k + BLOCK_QUERIES], limit)
                    yield at[k : k + BLOCK_QUERIES][i], rows[j], d, False

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ks, vs, qs, us = (batch.column(c)[k].values for c in range(4))
                for i, j, d, none in found(ks, vs, qs, us):
                    yield pa.RecordBatch.from_arrays([qs.take(pa.array(i)), ks.take(pa.array(j)), pa.nulls(len(i), pa.float64()) if none else pa.array(d)], ["q", "k", "distance"])

    top = pairs.mapInArrow(run, f"q {kinds[0]}, k {kinds[1]}, distance double").select(F.col("q").alias(query_key), F.col("k").alias(key), "distance")
    place = F.row_number().over(Window.partitionBy(query_key).orderBy("distance", key))
    return top.withColumn("rank", place).where(F.col("rank") <= limit)


def list_ids(base: DataFrame, where: dict | None = None, key: str = "id") -> DataFrame:
    return base.where(compile_where(where)).select(key)


class VectorStore:
    """Documents in Parquet snapshots below a root; one writer. A snapshot counts once it is written whole.

    RuntimeError if the store is of another format version or dimension than the one that opens it.
    """

    def __init__(self, spark: SparkSession, root: str, embedder):
        self.spark, self.root, self.embedder = spark, root, embedder
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        self._fs, self._path = path.getFileSystem(spark._jsc.hadoopConfiguration()), path
        self._dim = embedder.dim
        if (v := self._version()) and (held := self._format()) not in (None, FORMAT_VERSION):
            raise RuntimeError(f"the store at {root} has format version {held}, not {FORMAT_VERSION}")
        if v and (row := self.docs().select(F.size("embedding").alias("n")).first()) and row["n"] != embedder.dim:
            raise RuntimeError(f"snapshot {v} has dimension {row['n']}, the embedder {embedder.dim}")

    def _version(self) -> int:
        if not self._fs.exists(self._path):
            return 0
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath() for s in self._fs.listStatus(self._path)]
        return max((int(p.getName()[1:]) for p in names if p.getName()[1:].isdigit() and self._fs.exists(Path(p, "_SUCCESS"))), default=0)

    def _format(self) -> int | None:
        """The format version that the newest snapshot was written in; None if it doesn't tell."""
        path = f"{self.root}/v{self._version():08d}.format"
        if not self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path)):
            return None
        return int(self.spark.read.text(path).first()[0])

    def docs(self) -> DataFrame:
        v = self._version()
        return self.spark.read.schema(VECTORS).parquet(f"{self.root}/v{v:08d}") if v else self.spark.createDataFrame([], VECTORS)

    def _commit(self, df: DataFrame) -> None:
        name = f"{self.root}/v{self._version() + 1:08d}"
        self.spark.createDataFrame([(str(FORMAT_VERSION),)], "value string").coalesce(1).write.mode("overwrite").text(f"{name}.format")
        df.write.mode("overwrite").parquet(name)

    def _ids(self, ids: Iterable[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def upsert(self, docs: Sequence[dict]) -> None:
        """docs: dicts of id, text and metadata; the text is embedded and not kept. ValueError if the dimension has changed."""
        if not docs:
            return
        if (n := self.embedder.embed([docs[0]["text"]]).shape[1]) != self._dim:
            raise ValueError(f"the embedder gives dimension {n}, the store has {self._dim}")
        rows = [(n, d["id"], d["text"], *(d.get("metadata", {}).get(k) for k in INDEXED), {k: json.dumps(v, ensure_ascii=False) for k, v in d.get("metadata", {}).items() if k not in INDEXED}) for n, d in enumerate(docs)]
        new = self.spark.createDataFrame(rows, "n long, id string, text string, " + ", ".join(f"{k} {t}" for k, t in INDEXED.items()) + ", extras map<string,string>")
        self._commit(upsert(self.docs(), new.withColumn("embedding", self.embedder.column("text")), "n"))

    def delete(self, ids: Iterable[str]) -> None:
        self._commit(delete(self.docs(), self._ids(ids)))

    def update_metadata(self, ids: Iterable[str], patch: dict) -> None:
        self._commit(update_metadata(self.docs(), self._ids(ids), patch))

    def query(self, text: str, limit: int, where: dict | None = None) -> DataFrame:
        """rank, id, distance and metadata; the metadata of the winners only is read."""
        docs = self.docs()
        top = query(docs, self.embedder.embed([text])[0], limit, where)
        return metadata(docs.join(F.broadcast(top), "id")).select("rank", "id", "distance", "metadata").orderBy("rank")

    def list_ids(self, where: dict | None = None) -> DataFrame:
        return list_ids(self.docs(), where)

    def __len__(self) -> int:
        return self.docs().count()
