"""The Spark session that the library expects: UTC, ANSI-tolerant text handling through try_ functions, AQE on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "turnstore", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names; a new local one in local mode only."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-turnstore-")
