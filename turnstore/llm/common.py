"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstore.session import shared_folder

#: Rows whose crc32(doc_id as text) has this remainder modulo FOLDS are held out of every training set.
FOLDS, HELD_OUT = 5, 0

#: White space of the word definition `[^\x20\x09-\x0D]+`, as a Java and as a DuckDB character class.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows that no classifier may learn from; a null id counts as the empty string."""
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % FOLDS == HELD_OUT


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def share_of(h: Column, wanted: int, n: int) -> Column:
    """True for about twice `wanted` of n rows, by their hash: a bounded sample then comes from few rows of each task."""
    return F.pmod(h, F.lit(1 << 40)) < int(min(1.0, 2 * wanted / max(n, 1)) * (1 << 40))


def every(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever characters their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of the table has; upper and lower case count as equal."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, in the shared folder that spark.checkpoint.dir names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Ids that are sent to all tasks at most, instead of dealing the other table's rows by id.
SENT_IDS = 1_000_000


def sent_if_few(ids: DataFrame, most: int = SENT_IDS) -> DataFrame:
    """Materialised narrow rows, marked to be broadcast if they are counted to be few; else a join deals both sides."""
    return F.broadcast(ids) if ids.count() <= most else ids


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The documents whose ids aren't among the different ids `gone` (one column)."""
    (name,) = unused(docs, "gone")
    gone = sent_if_few(materialise(gone.toDF(name)))
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
