"""Summaries of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean, p50, p95, p99 (linear interpolation), min and max."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), p.alias("p"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(*keys, "n", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "min", "max")


def op_profile(df: DataFrame, keys: list[str], seconds: str, size: str) -> DataFrame:
    """Calls, seconds and bytes of each operation."""
    return df.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(seconds).alias("seconds"), F.sum(size).alias("bytes"))


def file_bytes(spark, paths: str | list[str]) -> DataFrame:
    """Bytes and files below paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("length")
    return found.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def median_of_repeats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """The median of the repeats of each measurement; of an even number the mean of the middle two."""
    return df.groupBy(*keys).agg(F.median(value).alias("median"))


def line_counts(spark, paths: str | list[str]) -> DataFrame:
    """Lines of each text file; a file without any isn't there."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"))
    return lines.groupBy("file").agg(F.count("*").alias("lines"))
