"""From log records to messages, tool calls, session attributes and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstore.functions.content import blocks_of, flatten_content, int_at, json_text, parse_timestamp, text_at, truth
from turnstore.schemas import USAGE

MESSAGE_TYPES = ["user", "assistant", "summary"]
#: Session attributes and the record keys that they come from.
ATTRIBUTES = {"cwd": "cwd", "git_branch": "gitBranch", "agent_version": "version", "session_id_original": "sessionId"}


def is_message() -> Column:
    return F.coalesce(F.col("type").isin(MESSAGE_TYPES), F.lit(False))


def message_columns() -> list[Column]:
    """The columns of schemas.MESSAGES that a record gives by itself, but session_id and seq."""
    r, content = F.col("record"), F.try_variant_get("record", "$.message.content", "variant")
    text = lambda path: F.coalesce(text_at(r, path), F.lit(""))
    return [
        text("$.uuid").alias("uuid"),
        text("$.parentUuid").alias("parent_uuid"),
        F.col("type"),
        text("$.message.role").alias("role"),
        text("$.message.model").alias("model"),
        parse_timestamp(r).alias("timestamp"),
        flatten_content(content).alias("content_text"),
        json_text(content).alias("content_json"),
        *(int_at(r, f"$.message.usage.{c}").alias(c) for c in USAGE),
        F.lit(None).cast("array<float>").alias("embedding"),
    ]


def messages(records: DataFrame) -> DataFrame:
    """One row for each message record, in the columns of schemas.MESSAGES; seq is dense in each session."""
    order = Window.partitionBy("session_id").orderBy("line_no")
    return records.where(is_message()).select("session_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), *message_columns())


def tool_blocks(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tool uses of assistant messages and the tool results of user messages, one row for each block."""
    r = F.col("record")
    blocks = records.where(F.col("type").isin("assistant", "user")).select(
        "session_id",
        "line_no",
        "type",
        F.coalesce(text_at(r, "$.uuid"), F.lit("")).alias("uuid"),
        parse_timestamp(r).alias("timestamp"),
        F.posexplode(blocks_of(F.try_variant_get(r, "$.message.content", "variant"))).alias("pos", "block"),
    )
    b = F.col("block")
    text = lambda path: F.coalesce(text_at(b, path), F.lit(""))
    kind = text_at(b, "$.type")
    at = F.struct("line_no", "pos").alias("at")
    given = F.try_variant_get(b, "$.input", "variant")
    uses = blocks.where((F.col("type") == "assistant") & (kind == "tool_use")).select(
        "session_id", at, text("$.id").alias("tool_use_id"), F.col("uuid").alias("message_uuid"), text("$.name").alias("name"), F.coalesce(F.to_json(given), F.lit("{}")).alias("args_json"), "timestamp"
    )
    results = blocks.where((F.col("type") == "user") & (kind == "tool_result")).select(
        "session_id", at, text("$.tool_use_id").alias("tool_use_id"), flatten_content(F.try_variant_get(b, "$.content", "variant")).alias("result_text"), F.col("uuid").alias("result_uuid"), truth(b, "$.is_error").alias("is_error"), "timestamp"
    )
    return uses, results


def pair(uses: DataFrame, results: DataFrame, session: str = "session_id", key: str = "tool_use_id", at: str = "at") -> DataFrame:
    """Uses with their results: an id's last result goes to its first use; results without a use stand alone.

    Both sides are reduced by (session, key) before one full outer join on it. Columns: session, key, use and result
    (structs of the other columns, null where there is none).
    """
    first = Window.partitionBy(session, key).orderBy(at)
    uses = uses.select(session, key, F.struct(*(c for c in uses.columns if c not in (session, key))).alias("use"), F.row_number().over(first).alias("nth"))
    rest = [c for c in results.columns if c not in (session, key)]
    # an orphan's place is that of the id's first result
    last = results.groupBy(session, key).agg(F.max_by(F.struct(*rest), at).alias("result"), F.min(at).alias("first_result"))
    last = last.withColumn("nth", F.lit(1))
    return uses.join(last, [session, key, "nth"], "full_outer")


def tool_calls(records: DataFrame) -> DataFrame:
    """Tool calls in batch mode, in the columns of schemas.TOOL_CALLS: every use, then results without a use."""
    paired = pair(*tool_blocks(records))
    order = Window.partitionBy("session_id").orderBy(F.col("use").isNull(), F.coalesce("use.at", "first_result"))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c.split(".")[1])
    return paired.select(
        "session_id",
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        "tool_use_id",
        text("use.message_uuid"),
        text("use.name"),
        text("use.args_json"),
        text("result.result_text"),
        text("result.result_uuid"),
        F.coalesce("use.timestamp", F.lit(0.0)).alias("timestamp"),
        F.coalesce("result.is_error", F.lit(False)).alias("is_error"),
    )


def first_attributes(records: DataFrame) -> DataFrame:
    """One row for each session: of each attribute, the value of the first record that has the key; null: none has it."""
    chosen = []
    for name, key in ATTRIBUTES.items():
        there = is_message() & F.try_variant_get("record", f"$.{key}", "variant").isNotNull()
        chosen.append(F.min_by(F.struct(text_at(F.col("record"), f"$.{key}").alias("v")), F.when(there, F.col("line_no")))["v"].alias(name))
    mode = F.col("type") == "permission-mode"
    chosen.append(F.min_by(F.struct(text_at(F.col("record"), "$.permissionMode").alias("v")), F.when(mode, F.col("line_no")))["v"].alias("permission_mode"))
    return records.groupBy("session_id").agg(*chosen)


def session_attributes(records: DataFrame) -> DataFrame:
    """first_attributes in the columns of schemas.SESSIONS; the empty string means none."""
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("cwd", "git_branch", "agent_version", "permission_mode", "session_id_original")]
    return first_attributes(records).select("session_id", F.lit("unknown").alias("model"), F.lit(None).cast("double").alias("created_at"), F.lit("").alias("summary"), *text)


def counters(records: DataFrame) -> DataFrame:
    """messages, tool_uses (with orphaned results), tool_results (blocks) and skipped records of each session."""
    uses, results = tool_blocks(records)
    blocks = uses.select("session_id", "tool_use_id", F.lit(1).alias("u"), F.lit(0).alias("r")).unionAll(results.select("session_id", "tool_use_id", F.lit(0).alias("u"), F.lit(1).alias("r")))
    by_id = blocks.groupBy("session_id", "tool_use_id").agg(F.sum("u").alias("u"), F.sum("r").alias("r"))
    tools = by_id.groupBy("session_id").agg(F.sum(F.greatest("u", F.lit(1))).alias("tool_uses"), F.sum("r").alias("tool_results"))
    base = records.groupBy("session_id").agg(F.count_if(is_message()).alias("messages"), F.count_if(~is_message()).alias("skipped"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return base.join(tools, "session_id", "left").select("session_id", "messages", zero("tool_uses"), zero("tool_results"), "skipped")
