"""Column functions over JSON records that are held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_at(v: Column, path: str) -> Column:
    """The string at a path; null if there is none or it is of another type."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))


def int_at(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "long"), F.lit(0).cast("long"))


def blocks_of(content: Column) -> Column:
    """The content's blocks; null if it isn't a list."""
    return content.try_cast("array<variant>")


def flatten_content(content: Column) -> Column:
    """Plain text of a message's content: strings as they are, the non-empty texts of blocks joined by newlines.

    A tool result that holds blocks is replaced by them, level by level, as often as its JSON names tool results: that
    is at least as deep as they are nested.
    """
    kind = lambda block: text_at(block, "$.type")
    inner = lambda block: F.try_variant_get(block, "$.content", "variant")
    opened = lambda block: F.coalesce(F.when(kind(block) == "tool_result", blocks_of(inner(block))), F.array(block))
    levels = F.array_repeat(F.lit(0), F.coalesce(F.regexp_count(F.to_json(content), F.lit('"tool_result"')), F.lit(0)))
    blocks = F.aggregate(levels, blocks_of(content), lambda found, _: F.flatten(F.transform(found, opened)))

    def text_of(block: Column) -> Column:
        is_ = kind(block)
        return F.coalesce(F.when(is_ == "text", text_at(block, "$.text")).when(is_ == "thinking", text_at(block, "$.thinking")).when(is_ == "tool_result", text_at(block, "$.content")), F.lit(""))

    parts = F.filter(F.transform(blocks, text_of), lambda t: t != "")
    return F.coalesce(F.array_join(parts, "\n"), text_at(content, "$"), F.lit(""))


def parse_timestamp(v: Column, path: str = "$.timestamp") -> Column:
    """Seconds since the epoch from a number or an ISO-8601 string (without a zone: UTC); 0 for anything else."""
    found = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(found)
    iso = F.unix_micros(F.try_variant_get(v, path, "string").try_cast("timestamp")) / 1e6
    number = F.try_variant_get(v, path, "double")
    return F.coalesce(F.when(kind == "STRING", iso).when(kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL"), number), F.lit(0.0))


def truth(v: Column, path: str) -> Column:
    """Whether the value at a path is there and not false, null, zero or empty; every string but the empty one is true."""
    found = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(found)
    plain = F.when(kind == "STRING", F.try_variant_get(v, path, "string") != "").when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
    plain = plain.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), ~F.to_json(found).isin("{}", "[]"))
    return F.coalesce(plain.otherwise(F.try_variant_get(v, path, "double") != 0), F.lit(False))


def json_text(v: Column) -> Column:
    """JSON of a variant; the empty string for a missing value or JSON null."""
    return F.coalesce(F.when(~F.is_variant_null(v), F.to_json(v)), F.lit(""))
