"""Sessions in files: messages, tool calls, artifacts and session attributes below one root, as Parquet or ORC.

A table has one folder for each of BUCKETS hashes of the session id, and in each file the rows of a session lie together
and in order: what one session holds is found by the folder and by the statistics of its files.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstore import schemas
from turnstore.operators import ingest, sessions
from turnstore.sources.jsonl import parse_lines, read_logs

TABLES = {"messages": schemas.MESSAGES, "tool_calls": schemas.TOOL_CALLS, "sessions": schemas.SESSIONS, "artifacts": schemas.ARTIFACTS}

BUCKETS = 64


def bucket(session_id: Column) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(BUCKETS)).cast("int")


class Store:
    """All sessions below a root. Appends are new files; a table that was never written is empty."""

    def __init__(self, spark: SparkSession, root: str, format: str = "parquet"):
        if format not in ("parquet", "orc"):
            raise ValueError(f"unknown format {format!r}")
        self.spark, self.root, self.format = spark, root, format

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str, session_id: str | None = None) -> DataFrame:
        """All rows of a table, or those of one session, which are read from its bucket only."""
        if not self._there(name):
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(f"{TABLES[name]}, bucket int").format(self.format).load(f"{self.root}/{name}")
        if session_id is not None:
            rows = rows.where((F.col("bucket") == bucket(F.lit(session_id))) & (F.col("session_id") == session_id))
        return rows.drop("bucket")

    def append(self, name: str, rows: DataFrame, few: bool = False) -> None:
        """Add rows; unless they are few, they are dealt by bucket, and a bucket of many rows is split."""
        self._write(name, rows, few, f"{self.root}/{name}")

    def _write(self, name: str, rows: DataFrame, few: bool, path: str) -> None:
        columns = self.spark.createDataFrame([], TABLES[name]).columns
        rows = rows.select(*columns, bucket(F.col("session_id")).alias("bucket"))
        rows = rows.coalesce(1) if few else rows.hint("rebalance", "bucket")
        order = ["bucket", "session_id", *(c for c in ("seq",) if c in columns)]
        rows.sortWithinPartitions(*order).write.mode("append").partitionBy("bucket").format(self.format).save(path)

    def rewrite(self, name: str) -> None:
        """Write a table anew: the many files of single appends become few. No one may append meanwhile."""
        if not self._there(name):
            return
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        new, old = f"{self.root}/{name}.{uuid.uuid4().hex}", f"{self.root}/{name}"
        self._write(name, self.table(name), False, new)
        fs = Path(old).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(Path(old), True)
        if not fs.rename(Path(new), Path(old)):
            raise OSError(f"{new} holds the rows of {name}, but couldn't take its place")

    def convert(self, paths: str | list[str], session_id: str | None = None, overwrite: bool = False) -> dict:
        """Take in logs; the counters over all of them. The session id is the file's stem unless given."""
        if overwrite:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        records = parse_lines(read_logs(self.spark, paths, session_id)).cache()
        try:
            self.append("messages", ingest.messages(records))
            self.append("tool_calls", ingest.tool_calls(records))
            self.append("sessions", ingest.session_attributes(records))
            names = ["messages", "tool_uses", "tool_results", "skipped"]
            return ingest.counters(records).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first().asDict()
        finally:
            records.unpersist()

    def inspect(self) -> DataFrame:
        """A row for each session that has a message or attributes; of its attribute rows the newest counts."""
        held = self.table("sessions")
        newest = held.groupBy("session_id").agg(F.max_by(F.struct(*held.columns[1:]), F.coalesce("created_at", F.lit(0.0))).alias("s"))
        newest = newest.select("session_id", "s.*")
        bare = self.table("messages").select("session_id").distinct().join(newest, "session_id", "left_anti")
        return sessions.inspect(newest.unionByName(bare, allowMissingColumns=True), self.table("messages"), self.table("tool_calls"))

    def list_sessions(self) -> DataFrame:
        """The ids of all sessions that have a message."""
        return self.table("messages").select("session_id").distinct()

    def export(self, out: str, session_id: str | None = None, overwrite: bool = False) -> None:
        """JSON lines of one session (the first by name unless given) as one text file in a folder."""
        chosen = session_id if session_id is not None else self.table("messages").agg(F.min("session_id")).first()[0]
        rows = self.table("messages", chosen) if chosen is not None else None
        if rows is None or rows.isEmpty():
            raise ValueError(f"no session {chosen!r}" if chosen is not None else "there is no session")
        sessions.export_records(rows).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(out)


class Session:
    """One session of a store."""

    def __init__(self, store: Store, session_id: str | None = None):
        self.store, self.session_id = store, session_id or str(uuid.uuid4())[:8]

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held back: every append is committed when it returns."""

    def _mine(self, name: str) -> DataFrame:
        return self.store.table(name, self.session_id)

    def _next(self, name: str) -> int:
        return self._mine(name).agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]

    def add_turns(self, turns: Sequence[tuple[str, str] | tuple[str, str, Sequence[float] | None]]) -> list[str]:
        """Append (role, content, embedding or nothing) in one write; the turns' ids."""
        if not turns:
            return []
        vectors = [None if len(t) < 3 or t[2] is None else np.asarray(t[2], np.float32).ravel().tolist() for t in turns]
        dims = {len(v) for v in vectors if v is not None}
        held = self._mine("messages").where("embedding is not null").select(F.size("embedding").alias("n")).first() if dims else None
        if len(dims | ({held["n"]} if held else set())) > 1:
            raise ValueError("embeddings of a session have one dimension")
        start, now, ids = self._next("messages"), time.time(), [str(uuid.uuid4())[:12] for _ in turns]
        rows = [(self.session_id, start + k, ids[k], "", t[0], t[0], "", now, t[1], json.dumps(t[1]), 0, 0, 0, 0, vectors[k]) for k, t in enumerate(turns)]
        self.store.append("messages", self.store.spark.createDataFrame(rows, schemas.MESSAGES), few=True)
        return ids

    def add_turn(self, role: str, content: str, embedding: Sequence[float] | None = None) -> str:
        return self.add_turns([(role, content, embedding)])[0]

    def add_tool_call(
        self, name: str, args: dict, result_text: str | None = None, result_data: np.ndarray | None = None, message_uuid: str = "", result_uuid: str = "", is_error: bool = False
    ) -> str:
        call = str(uuid.uuid4())[:12]
        row = (self.session_id, self._next("tool_calls"), call, message_uuid, name, json.dumps(args), result_text or "", result_uuid, time.time(), is_error)
        self.store.append("tool_calls", self.store.spark.createDataFrame([row], schemas.TOOL_CALLS), few=True)
        if result_data is not None:
            self.store_artifact(f"tool:{call}", result_data)
        return call

    def get_recent_context(self, n: int = 20) -> DataFrame:
        return sessions.recent_context(sessions.turn_view(self._mine("messages")), n, self.session_id)

    def store_artifact(self, name: str, data: np.ndarray) -> None:
        """The newest version of a name counts."""
        data = np.ascontiguousarray(data)
        row = (self.session_id, name, time.time_ns(), data.dtype.str, [*map(int, data.shape)], data.tobytes())
        self.store.append("artifacts", self.store.spark.createDataFrame([row], schemas.ARTIFACTS), few=True)

    def get_artifact(self, name: str) -> np.ndarray | None:
        row = self._mine("artifacts").where(F.col("name") == name).orderBy(F.col("version").desc()).first()
        return np.frombuffer(bytes(row["data"]), row["dtype"]).reshape(row["shape"]) if row else None

    def turn_count(self) -> int:
        return self._mine("messages").count()

    def total_usage(self) -> dict[str, int]:
        return sessions.usage_totals(self._mine("messages")).first().asDict()

    def set_session_attrs(self, **attrs: str | None) -> None:
        """None leaves an attribute as it is; the newest row of a session counts, so its other values are carried over."""
        old = self._mine("sessions").orderBy(F.col("created_at").desc_nulls_last()).first()
        row = {**({k: None for k in self.store.table("sessions").columns} if old is None else old.asDict()), **{k: v for k, v in attrs.items() if v is not None}}
        row |= {"session_id": self.session_id, "created_at": time.time()}
        self.store.append("sessions", self.store.spark.createDataFrame([row], schemas.SESSIONS), few=True)

    def attrs(self) -> dict:
        row = self._mine("sessions").orderBy(F.col("created_at").desc_nulls_last()).first()
        return row.asDict() if row else {}
