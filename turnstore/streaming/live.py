"""Incremental sync of session logs with Structured Streaming.

Logs arrive as rolled segments: JSONL files whose rows hold session_id, line_no and the line; `tail_log` makes a segment
of the lines that a growing log has got since its last one. The checkpoint is the durable cursor. Each micro-batch writes
its messages, tool calls, session attributes and the uses that still wait for a result to folders named by its number: a
batch that runs again after a failure writes the same folders anew. A use waits, for ever if need be, until its result
comes; a result without a waiting use is emitted at once. A sync with nothing new does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstore import schemas
from turnstore.operators import ingest
from turnstore.sources.jsonl import parse_lines, read_logs

SEGMENT = "session_id string, line_no long, line string"
CALLS = "session_id string, tool_use_id string, message_uuid string, name string, args_json string, result_text string, result_uuid string, timestamp double, is_error boolean"
PENDING = "session_id string, tool_use_id string, uuid string, name string, args_json string, timestamp double"
ATTRIBUTES = "session_id string, cwd string, git_branch string, agent_version string, session_id_original string, permission_mode string"
TABLES = {"messages": schemas.MESSAGES, "tool_calls": CALLS, "attributes": ATTRIBUTES}


def or_now(timestamp: str):
    """A record without a time counts as written now."""
    return F.when(F.col(timestamp) != 0, F.col(timestamp)).otherwise(F.unix_micros(F.current_timestamp()) / 1e6).alias("timestamp")


def live_messages(records: DataFrame) -> DataFrame:
    """As ingest.messages, but line_no is the order."""
    m = records.where(ingest.is_message()).select("session_id", F.col("line_no").cast("long").alias("seq"), *ingest.message_columns())
    return m.withColumn("timestamp", or_now("timestamp"))


def live_blocks(records: DataFrame) -> DataFrame:
    """Uses and results as rows of one form, with their place in the log."""
    uses, results = ingest.tool_blocks(records)
    none = lambda c, t="string": F.lit(None).cast(t).alias(c)
    uses = uses.select("session_id", "tool_use_id", "at", F.lit(True).alias("is_use"), F.col("message_uuid").alias("uuid"), "name", "args_json", or_now("timestamp"), none("result_text"), none("is_error", "boolean"))
    results = results.select("session_id", "tool_use_id", "at", F.lit(False).alias("is_use"), F.col("result_uuid").alias("uuid"), none("name"), none("args_json"), or_now("timestamp"), "result_text", "is_error")
    return uses.unionByName(results)


def rounds(blocks: DataFrame, waiting: DataFrame) -> DataFrame:
    """For each id and each of its results: the result, and the last use since the result before; uses after the last
    result wait. Columns: session_id, tool_use_id, use and result (structs; null where there is none)."""
    first = F.struct(F.lit(-1).cast("int").alias("line_no"), F.lit(0).alias("pos"))
    before = waiting.withColumn("at", first.cast(blocks.schema["at"].dataType)).withColumn("is_use", F.lit(True))
    every = blocks.unionByName(before, allowMissingColumns=True)
    w = Window.partitionBy("session_id", "tool_use_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("round", F.coalesce(F.sum(F.when(~F.col("is_use"), 1)).over(w), F.lit(0)))
    last = lambda on, *columns: F.max_by(F.struct(*columns), F.when(on, F.col("at")))
    return every.groupBy("session_id", "tool_use_id", "round").agg(
        last(F.col("is_use"), "uuid", "name", "args_json", "timestamp").alias("use"),
        last(~F.col("is_use"), "uuid", "result_text", "is_error", "timestamp").alias("result"),
    )


def take_in(batch: DataFrame, n: int, store: str) -> None:
    """Write what micro-batch n gives; the uses that waited before it are those that batch n - 1 has left."""
    spark = batch.sparkSession
    records = parse_lines(batch).persist()
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{store}/{name}/batch={n}")
    try:
        put(live_messages(records), "messages")
        put(ingest.first_attributes(records).selectExpr(*(c.split()[0] for c in ATTRIBUTES.split(", "))), "attributes")
        waiting = spark.read.schema(PENDING).parquet(f"{store}/_waiting/batch={n - 1}") if n else spark.createDataFrame([], PENDING)
        found = rounds(live_blocks(records), waiting.drop("batch")).persist()
        text = lambda c: F.coalesce(F.col(c), F.lit(""))
        ended = found.where("result is not null")
        put(
            ended.select(
                "session_id", "tool_use_id", text("use.uuid").alias("message_uuid"), text("use.name").alias("name"), text("use.args_json").alias("args_json"),
                "result.result_text", F.col("result.uuid").alias("result_uuid"), F.coalesce("use.timestamp", "result.timestamp").alias("timestamp"), "result.is_error",
            ),
            "tool_calls",
        )
        put(found.where("result is null").select("session_id", "tool_use_id", "use.*"), "_waiting")
        found.unpersist()
    finally:
        records.unpersist()


def sync(spark: SparkSession, segments: str, store: str) -> None:
    """Take in all segments that are new since the last call."""
    lines = spark.readStream.schema(SEGMENT).json(segments)
    query = lines.writeStream.foreachBatch(lambda batch, n: take_in(batch, n, store)).option("checkpointLocation", f"{store}/_cursor")
    query.trigger(availableNow=True).start().awaitTermination()


def tail_log(spark: SparkSession, log: str, segments: str, session_id: str) -> int:
    """Make a segment of the lines of a log from the cursor on, the place after the last line of its segments; the new cursor.

    A segment is seen once its write is committed, so a call that fails leaves the cursor where it was.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(segments)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    held = spark.read.schema(SEGMENT).option("recursiveFileLookup", "true").json(segments) if there else spark.createDataFrame([], SEGMENT)
    cursor = held.where(F.col("session_id") == session_id).agg(F.coalesce(F.max("line_no") + 1, F.lit(0))).first()[0]
    new = read_logs(spark, log, session_id).where(F.col("line_no") >= cursor).select("session_id", F.col("line_no").cast("long").alias("line_no"), "line").persist()
    try:
        last = new.agg(F.max("line_no")).first()[0]
        if last is not None:
            new.write.mode("append").json(segments)
        return cursor if last is None else last + 1
    finally:
        new.unpersist()


def table(spark: SparkSession, store: str, name: str) -> DataFrame:
    """What all batches have written so far to a table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{TABLES[name]}, batch int")
    return spark.read.schema(f"{TABLES[name]}, batch int").parquet(f"{store}/{name}")


def session_attributes(spark: SparkSession, store: str) -> DataFrame:
    """Of each session and attribute the first value in the latest batch that has one; null: none has."""
    rows = table(spark, store, "attributes")
    names = [c for c in rows.columns if c not in ("session_id", "batch")]
    return rows.groupBy("session_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c) for c in names))
