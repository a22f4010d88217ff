"""JSONL session logs as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_logs(spark: SparkSession, paths: str | list[str], session_id: str | None = None) -> DataFrame:
    """session_id (the file's stem unless given), line_no and line of the non-blank lines of logs.

    A log of any size is read by splits: lines are numbered inside each split, and the lines of the splits before it,
    a few numbers for each file, are added.
    """
    meta = lambda c: F.col(f"_metadata.{c}").alias(c)
    split = ["file_path", "file_block_start"]
    lines = spark.read.text(paths).select("value", meta("file_name"), *map(meta, split), F.monotonically_increasing_id().alias("at"))
    earlier = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    before = lines.groupBy(*split).agg(F.count("*").alias("n")).select(*split, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*split).orderBy("at"))
    sid = F.lit(session_id) if session_id else F.regexp_extract(F.url_decode("file_name"), r"^(.*?)(\.jsonl)?$", 1)
    numbered = lines.withColumn("k", inside).join(before, split)
    return numbered.select(sid.alias("session_id"), (F.col("before") + F.col("k") - 1).alias("line_no"), F.trim("value").alias("line")).where("line != ''")


def find_log(spark: SparkSession, root: str, session_id: str) -> str | None:
    """The log of a session below a root of project folders; of several the first by path, None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/{session_id}.jsonl")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return min((f.getPath().toString() for f in found), default=None)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add `record` (VARIANT) and `type`; lines that aren't JSON objects are left out."""
    parsed = lines.withColumn("record", F.try_parse_json("line")).where("record is not null")
    parsed = parsed.where(F.schema_of_variant("record").startswith("OBJECT"))
    return parsed.withColumn("type", F.try_variant_get("record", "$.type", "string")).drop("line")
