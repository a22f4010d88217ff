"""Queries over messages and tool calls of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstore.schemas import USAGE


def recent_context(turns: DataFrame, n: int, session: str | None = None, key: str = "session_id", order: str = "seq") -> DataFrame:
    """The last n rows: of one session, in order (a top-k), or of every session, as they lie (a window limited by group)."""
    if n <= 0:
        return turns.limit(0)
    if session is not None:
        return turns.where(F.col(key) == session).orderBy(F.col(order).desc()).limit(n).orderBy(order)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return turns.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def turn_view(messages: DataFrame) -> DataFrame:
    return messages.select("session_id", "seq", F.col("uuid").alias("turn_id"), "role", F.col("content_text").alias("content"), "timestamp", "embedding")


def turn_counts(turns: DataFrame, key: str = "session_id") -> DataFrame:
    return turns.groupBy(key).agg(F.count("*").alias("turns"))


def usage_totals(messages: DataFrame, *keys: str, columns: list[str] = USAGE) -> DataFrame:
    """Sums of the token counters, over all rows or by key; 0 where there are none."""
    return messages.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns))


def cache_hit_rate(messages: DataFrame, *keys: str) -> DataFrame:
    """Share of the prompt tokens that came from the cache; null without any."""
    sums = usage_totals(messages, *keys)
    prompt = F.col("input_tokens") + F.col("cache_creation_input_tokens") + F.col("cache_read_input_tokens")
    return sums.select(*keys, (F.col("cache_read_input_tokens") / F.nullif(prompt, F.lit(0))).alias("cache_hit_rate"))


def tool_errors(calls: DataFrame) -> DataFrame:
    """Calls, errors and the error rate of each tool."""
    return calls.groupBy("name").agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"), F.avg(F.col("is_error").cast("double")).alias("error_rate"))


def with_messages(calls: DataFrame, messages: DataFrame) -> DataFrame:
    """Tool calls beside the messages that made the call and that brought the result (structs; null where there is none)."""
    asked = messages.select("session_id", F.col("uuid").alias("message_uuid"), F.struct(*messages.columns).alias("message"))
    brought = messages.select("session_id", F.col("uuid").alias("result_uuid"), F.struct(*messages.columns).alias("result_message"))
    return calls.join(asked, ["session_id", "message_uuid"], "left").join(brought, ["session_id", "result_uuid"], "left")


def call_args(calls: DataFrame, name: str) -> DataFrame:
    """The arguments of every call of one tool, as VARIANT; null if they aren't JSON."""
    return calls.where(F.col("name") == name).select("session_id", "tool_use_id", F.try_parse_json("args_json").alias("args"))


def inspect(sessions: DataFrame, messages: DataFrame, calls: DataFrame) -> DataFrame:
    """One row for each session: its attributes, messages, tool calls and token sums."""
    m = messages.groupBy("session_id").agg(F.count("*").alias("messages"), *(F.sum(c).alias(c) for c in USAGE))
    c = calls.groupBy("session_id").agg(F.count("*").alias("tool_calls"))
    zero = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("messages", "tool_calls", *USAGE)]
    return sessions.join(m, "session_id", "left").join(c, "session_id", "left").select(*sessions.columns, *zero)


def export_records(messages: DataFrame) -> DataFrame:
    """JSON lines of messages, in order; what wasn't kept of a record (its working directory, say) isn't there."""
    content = F.try_parse_json(F.nullif("content_json", F.lit("")))
    usage = F.struct(*USAGE).alias("usage")
    message = F.struct("role", "model", content.alias("content"), usage).alias("message")
    record = F.struct("type", "uuid", F.nullif("parent_uuid", F.lit("")).alias("parentUuid"), "timestamp", message)
    return messages.orderBy("session_id", "seq").select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def parent_chain(messages: DataFrame) -> DataFrame:
    """Messages beside their parents."""
    parents = messages.select("session_id", F.col("uuid").alias("parent_uuid"), F.col("seq").alias("parent_seq"), F.col("role").alias("parent_role"))
    return messages.where("parent_uuid != ''").join(parents, ["session_id", "parent_uuid"])
