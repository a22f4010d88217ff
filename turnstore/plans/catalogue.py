"""Registered queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstore.functions import vectors as fv
from turnstore.functions.content import flatten_content, parse_timestamp
from turnstore.operators import ingest, metrics, sessions, vectors
from turnstore.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as turns of sessions."""
    return t(spark, sf_dir, "conversations").withColumnsRenamed({"conv_id": "session_id", "turn": "seq"})


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("select conv_id as session_id, turn as seq, role, text from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 2")
def recent_context(spark, sf_dir):
    return sessions.recent_context(turns(spark, sf_dir), 2)


@query("select conv_id as session_id, turn as seq, role, text from conversations where conv_id = 3 order by turn desc limit 20")
def recent_context_one(spark, sf_dir):
    return sessions.recent_context(turns(spark, sf_dir), 20, session=3)


@query("select conv_id as session_id, count(*) as turns from conversations group by 1")
def turn_counts(spark, sf_dir):
    return sessions.turn_counts(turns(spark, sf_dir))


COUNTERS = {"input_tokens": "l_quantity", "output_tokens": "l_extendedprice", "cache_creation_input_tokens": "l_linenumber", "cache_read_input_tokens": "l_suppkey"}
_SUMS = ", ".join(f"sum({c}::bigint)::bigint as {n}" for n, c in COUNTERS.items()).replace("l_extendedprice::bigint", "floor(l_extendedprice)::bigint")


def usage(spark, sf_dir) -> DataFrame:
    """Four columns of lineitem as token counters; orders are the sessions."""
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), *(F.floor(c).cast("long").alias(n) for n, c in COUNTERS.items()))


@query(f"select {_SUMS} from lineitem")
def usage_totals(spark, sf_dir):
    return sessions.usage_totals(usage(spark, sf_dir))


@query(f"select l_orderkey as session_id, {_SUMS} from lineitem group by 1")
def usage_by_session(spark, sf_dir):
    return sessions.usage_totals(usage(spark, sf_dir), "session_id")


@query("select l_returnflag, round(sum(l_suppkey)::double / sum(l_quantity::bigint + l_linenumber + l_suppkey)::double, 9) as cache_hit_rate from lineitem group by 1")
def cache_hit_rate(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_returnflag", *(F.floor(c).cast("long").alias(n) for n, c in COUNTERS.items()))
    return sessions.cache_hit_rate(rows, "l_returnflag").withColumn("cache_hit_rate", F.round("cache_hit_rate", 9))


@query(
    """select s.session_id, 'unknown' as model, m.messages::bigint as messages, coalesce(c.n, 0)::bigint as tool_calls, m.i::bigint as input_tokens, m.o::bigint as output_tokens, 0::bigint as cache_creation_input_tokens, 0::bigint as cache_read_input_tokens
    from (select distinct conv_id as session_id from conversations) s
    join (select conv_id, count(*) as messages, sum(length(text)) filter (role = 'user') as i, sum(length(text)) filter (role <> 'user') as o from conversations group by 1) m on m.conv_id = s.session_id
    left join (select user_id, count(*) as n from events group by 1) c on c.user_id = s.session_id"""
)
def session_inspect(spark, sf_dir):
    n = F.length("text")
    zero = F.lit(0).cast("long")
    m = turns(spark, sf_dir).withColumns({"input_tokens": F.when(F.col("role") == "user", n), "output_tokens": F.when(F.col("role") != "user", n), "cache_creation_input_tokens": zero, "cache_read_input_tokens": zero})
    calls = t(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"))
    return sessions.inspect(m.select("session_id", F.lit("unknown").alias("model")).distinct(), m, calls)


@query("select count(*) filter (event_type in ('click', 'view', 'purchase')) as messages, count(*) filter (event_type not in ('click', 'view', 'purchase')) as skipped from events")
def record_type_filter(spark, sf_dir):
    """Clicks, views and purchases as the three kinds of messages."""
    kinds = F.create_map(*(F.lit(x) for x in ("click", "user", "view", "assistant", "purchase", "summary")))
    records = t(spark, sf_dir, "events").select(F.coalesce(kinds[F.col("event_type")], "event_type").alias("type"))
    return records.agg(F.count_if(ingest.is_message()).alias("messages"), F.count_if(~ingest.is_message()).alias("skipped"))


def paired_events(spark, sf_dir) -> DataFrame:
    """Clicks as uses and purchases as results, four neighbouring events sharing an id: ids repeat or miss on both sides."""
    e = t(spark, sf_dir, "events").select(F.lit(0).alias("session_id"), F.expr("event_id div 4").alias("tool_use_id"), F.col("event_id").alias("at"), "event_type", "value")
    uses, results = e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type")
    return ingest.pair(uses, results).select("tool_use_id", F.col("use.at").alias("use_id"), F.col("result.at").alias("result_id"), F.col("result.value").alias("result_value"))


_PAIRED = """with e as (select *, event_id // 4 as id from events), u as (select id, event_id, row_number() over (partition by id order by event_id) as n from e where event_type = 'click'),
r as (select id, max(event_id) as event_id, arg_max(value, event_id) as value, 1 as n from e where event_type = 'purchase' group by 1),
p as (select coalesce(u.id, r.id) as tool_use_id, u.event_id as use_id, r.event_id as result_id, r.value as result_value from u full join r on r.id = u.id and r.n = u.n) select * from p"""


@query(_PAIRED)
def tool_pairing_batch(spark, sf_dir):
    return paired_events(spark, sf_dir)


@query(_PAIRED + " where use_id is null")
def tool_orphans(spark, sf_dir):
    return paired_events(spark, sf_dir).where("use_id is null")


@query(_PAIRED + " where result_id is null")
def unmatched_uses(spark, sf_dir):
    return paired_events(spark, sf_dir).where("result_id is null")


@query("select event_type as name, count(*) as calls, count(*) filter (value > 50) as errors, round(avg((value > 50)::int), 9) as error_rate from events where value is not null group by 1")
def error_by_tool(spark, sf_dir):
    calls = t(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("name"), (F.col("value") > 50).alias("is_error"))
    return sessions.tool_errors(calls).withColumn("error_rate", F.round("error_rate", 9))


@query("select user_id, arg_min(event_type, event_id) as event_type, min(event_id) as first_id from events group by 1")
def first_seen_attrs(spark, sf_dir):
    """Events as messages of their user's session, whose attributes are those of the first one."""
    record = F.try_parse_json(F.to_json(F.struct(F.col("event_type").alias("cwd"), F.col("event_id").cast("string").alias("version"))))
    records = t(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("line_no"), F.lit("user").alias("type"), record.alias("record"))
    found = ingest.session_attributes(records)
    return found.select(F.col("session_id").alias("user_id"), F.col("cwd").alias("event_type"), F.col("agent_version").cast("long").alias("first_id"))


@query("select conv_id, turn, role || chr(10) || text || chr(10) || 'out' as flat from conversations where text <> ''")
def content_flatten(spark, sf_dir):
    """Turns as JSON content of four blocks, parsed and flattened."""
    block = lambda kind, **kw: F.to_json(F.struct(F.lit(kind).alias("type"), *(v.alias(k) for k, v in kw.items())))
    parts = [block("text", text=F.col("role")), block("thinking", thinking=F.col("text")), block("tool_use", name=F.lit("x")), F.lit('{"type":"tool_result","content":[{"type":"text","text":"out"}]}')]
    content = F.try_parse_json(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")))
    return t(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", flatten_content(content).alias("flat"))


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def json_props_extract(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("select event_id, epoch_us(ts) / 1e6 as seconds from events")
def ts_parse_epoch(spark, sf_dir):
    record = F.try_parse_json(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"))))
    return t(spark, sf_dir, "events").select("event_id", parse_timestamp(record).alias("seconds"))


@query("select conv_id as session_id, turn as seq, role, 'm' || turn as uuid, case when turn > 0 then 'm' || (turn - 1) end as parent, text as content, length(text) as tokens from conversations")
def export_records(spark, sf_dir):
    """Messages to JSON lines and back."""
    zero = F.lit(0).cast("long")
    parent = F.when(F.col("seq") > 0, F.concat(F.lit("m"), F.col("seq") - 1)).otherwise("")
    m = turns(spark, sf_dir).select("session_id", "seq", F.concat(F.lit("m"), F.col("seq")).alias("uuid"), parent.alias("parent_uuid"), F.col("role").alias("type"), "role", F.lit("").alias("model"), F.col("session_id").cast("double").alias("timestamp"),
                                    F.regexp_extract(F.to_json(F.struct(F.col("text").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1).alias("content_json"), F.length("text").cast("long").alias("input_tokens"), zero.alias("output_tokens"), zero.alias("cache_creation_input_tokens"), zero.alias("cache_read_input_tokens"))
    v = sessions.export_records(m).select(F.try_parse_json("value").alias("v"))
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    uuid_ = get("$.uuid")
    return v.select(get("$.timestamp", "long").alias("session_id"), F.substring(uuid_, 2, 20).cast("long").alias("seq"), get("$.message.role").alias("role"), uuid_.alias("uuid"), get("$.parentUuid").alias("parent"), get("$.message.content").alias("content"), get("$.message.usage.input_tokens", "long").alias("tokens"))


@query("select conv_id as session_id, turn as seq, lag(turn) over w as parent_seq, lag(role) over w as parent_role from conversations window w as (partition by conv_id order by turn) qualify parent_seq is not null")
def parent_chain(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("seq").over(Window.partitionBy("session_id").orderBy("seq"))
    m = turns(spark, sf_dir).select("session_id", "seq", "role", F.concat(F.lit("m"), "seq").alias("uuid"), F.coalesce(F.concat(F.lit("m"), before), F.lit("")).alias("parent_uuid"))
    return sessions.parent_chain(m).select("session_id", "seq", "parent_seq", "parent_role")


@query("""select c.event_id as call, c.event_type as name, m.role as role, r.text as result_text from events c
    left join conversations m on m.conv_id = c.user_id and m.turn = c.event_id % 5 left join conversations r on r.conv_id = c.user_id and r.turn = c.event_id % 5 + 1""")
def calls_with_messages(spark, sf_dir):
    """Events as tool calls that a turn of the user's conversation made and the next one answered."""
    m = turns(spark, sf_dir).withColumn("uuid", F.concat(F.lit("m"), "seq"))
    of = lambda k: F.concat(F.lit("m"), F.col("event_id") % 5 + k)
    calls = t(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("call"), F.col("event_type").alias("name"), of(0).alias("message_uuid"), of(1).alias("result_uuid"))
    return sessions.with_messages(calls, m).select("call", "name", F.col("message.role").alias("role"), F.col("result_message.text").alias("result_text"))


@query("select event_id::varchar as tool_use_id, json_extract(props, '$.k')::bigint as k from events where event_type = 'purchase'")
def args_of_calls(spark, sf_dir):
    """The arguments of every call of one tool."""
    calls = t(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").cast("string").alias("tool_use_id"), F.col("event_type").alias("name"), F.col("props").alias("args_json"))
    return sessions.call_args(calls, "purchase").select("tool_use_id", F.try_variant_get("args", "$.k", "long").alias("k"))


@query("select event_type, round(median(value), 6) as median from events group by 1")
def median_of_repeats(spark, sf_dir):
    return metrics.median_of_repeats(t(spark, sf_dir, "events"), "value", "event_type").withColumn("median", F.round("median", 6))


@query("select role as file, sum(length(text) - length(replace(text, chr(10), '')) + 1)::bigint as lines from conversations where text <> '' and not suffix(text, chr(10)) group by 1")
def line_counts(spark, sf_dir):
    """The texts of each role as text files, counted by line."""
    path = scratch(spark, "lines")
    # a text that ends in a line feed would end two lines
    rows = t(spark, sf_dir, "conversations").where("text <> '' and not endswith(text, '\n')").select("role", "text")
    rows.write.partitionBy("role").text(path)
    counted = metrics.line_counts(spark, path).withColumn("file", F.regexp_extract("file", "role=([^/]*)", 1))
    return counted.groupBy("file").agg(F.sum("lines").alias("lines"))


def vector_docs(spark, sf_dir) -> DataFrame:
    """embeddings as documents: the label is the project, the id's remainder the document type."""
    kind = F.when(F.col("vec_id") % 10 < 7, "observation").when(F.col("vec_id") % 10 < 9, "session_summary").otherwise("user_prompt")
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", kind.alias("doc_type"), F.col("vec_id").alias("sqlite_id"), F.concat(F.lit("project_"), "label").alias("project"))


_DOCS = "select vec_id as id, embedding::double[] as e, 'project_' || label as project, case when vec_id % 10 < 7 then 'observation' when vec_id % 10 < 9 then 'session_summary' else 'user_prompt' end as doc_type from embeddings"


def _topk(where: str) -> str:
    return f"""with d as ({_DOCS}), q as (select e as v from d where id = 0), s as (select id, 1 - list_dot_product(e, v) as distance from d, q where {where})
    select row_number() over (order by distance, id) as rank, id, round(distance, 6) + 0.0 as distance from s order by 1 limit 20"""


def nearest(spark, sf_dir, where=None) -> DataFrame:
    docs = vector_docs(spark, sf_dir)
    first = docs.where("id = 0").select("embedding").first()["embedding"]
    return vectors.query(docs, first, 20, where).withColumn("distance", F.round("distance", 6) + 0.0)


@query(_topk("true"))
def cosine_topk(spark, sf_dir):
    return nearest(spark, sf_dir)


@query(_topk("project = 'project_1'"))
def cosine_topk_filtered(spark, sf_dir):
    return nearest(spark, sf_dir, {"project": "project_1"})


@query(_topk("project = 'project_1' and doc_type = 'observation'"))
def cosine_topk_and(spark, sf_dir):
    return nearest(spark, sf_dir, {"$and": [{"project": "project_1"}, {"doc_type": "observation"}]})


@query(f"""with d as ({_DOCS}), s as (select q.id as query_id, d.id, 1 - list_dot_product(d.e, q.e) as distance from d, d q where q.id % 100 = 0)
    select query_id, id, round(distance, 6) + 0.0 as distance, row_number() over (partition by query_id order by distance, id) as rank from s qualify rank <= 5""")
def cosine_topk_batch(spark, sf_dir):
    docs = vector_docs(spark, sf_dir)
    wanted = docs.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.query_batch(docs, wanted, 5).withColumn("distance", F.round("distance", 6) + 0.0)


@query(f"select id from ({_DOCS}) where project = 'project_1' and doc_type = 'user_prompt'")
def list_ids_where(spark, sf_dir):
    return vectors.list_ids(vector_docs(spark, sf_dir), {"$and": [{"project": "project_1"}, {"doc_type": "user_prompt"}]})


@query(f"select id, round(sqrt(list_dot_product(e, e)), 5) as norm from ({_DOCS})")
def unit_norm(spark, sf_dir):
    return vector_docs(spark, sf_dir).select("id", F.round(fv.norm(F.col("embedding")), 5).alias("norm"))


@query("""with new as (select doc_id // 2 as id, lang, 'new' as source, doc_id as n from documents), last as (select * from new qualify row_number() over (partition by id order by n desc) = 1)
    select doc_id as id, lang, source from documents where doc_id not in (select id from last) union all select id, lang, source from last""")
def upsert_lastwins(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    new = d.select(F.expr("doc_id div 2").alias("id"), "lang", F.lit("new").alias("source"), F.col("doc_id").alias("n"))
    return vectors.upsert(d.select(F.col("doc_id").alias("id"), "lang", "source"), new, "n")


@query("select doc_id as id, lang, source from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def delete_ids(spark, sf_dir):
    toxic = t(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return vectors.delete(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source"), toxic)


@query("select doc_id as id, case when l.doc_id is not null then 'patched' else source end as project from documents left join (select distinct doc_id from labels where quality = 0) l using (doc_id)")
def update_metadata(spark, sf_dir):
    base = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project"))
    ids = t(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return vectors.update_metadata(base, ids, {"project": "patched"})


@query("select doc_id, source as project, n_chars as created_at_epoch, lang as lang from documents")
def metadata_split_merge(spark, sf_dir):
    """Columns and overflow to one map of JSON values, and back."""
    none = lambda k, kind: F.lit(None).cast(kind).alias(k)
    docs = t(spark, sf_dir, "documents").select("doc_id", none("doc_type", "string"), none("sqlite_id", "long"), F.col("source").alias("project"), none("field_type", "string"), F.col("n_chars").alias("created_at_epoch"), F.create_map(F.lit("lang"), F.concat(F.lit('"'), "lang", F.lit('"'))).alias("extras"))
    m = vectors.metadata(docs).select("doc_id", "metadata")
    return m.select("doc_id", F.trim(F.col("metadata")["project"], F.lit('"')).alias("project"), F.col("metadata")["created_at_epoch"].cast("long").alias("created_at_epoch"), F.trim(F.col("metadata")["lang"], F.lit('"')).alias("lang"))


@query("""select event_type, count(value) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(min(value), 6) as min, round(max(value), 6) as max from events group by 1""")
def latency_summary(spark, sf_dir):
    out = metrics.latency_summary(t(spark, sf_dir, "events"), "value", "event_type")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95", "p99", "min", "max")})


@query("select user_id % 4 as phase, event_type as op, count(*) as calls, round(sum(value), 4) as seconds, sum(event_id)::bigint as bytes from events group by 1, 2")
def op_profile(spark, sf_dir):
    e = t(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("phase"), F.col("event_type").alias("op"), "value", "event_id")
    return metrics.op_profile(e, ["phase", "op"], "value", "event_id").withColumn("seconds", F.round("seconds", 4))


@query("select distinct conv_id as session_id from conversations")
def multi_session_list(spark, sf_dir):
    return turns(spark, sf_dir).select("session_id").distinct()


@query("select conv_id, turn, role, text from conversations")
def orc_roundtrip(spark, sf_dir):
    path = scratch(spark, "orc")
    t(spark, sf_dir, "conversations").write.orc(path)
    return spark.read.orc(path).select("conv_id", "turn", "role", "text")


@query("select user_id, event_type as name, arg_max(value, event_id) as value, max(event_id) as version from events group by 1, 2")
def artifact_latest(spark, sf_dir):
    """Of each name the newest version."""
    return t(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("version"))


@query("""with b as (select user_id, event_id, event_type = 'click' as is_use, sum((event_type = 'purchase')::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as results
    from events where event_type in ('click', 'purchase')),
    last as (select user_id, coalesce(results, 0) as g, max(event_id) filter (is_use) as use_id, max(event_id) filter (not is_use) as result_id from b group by 1, 2)
    select user_id::varchar as tool_use_id, result_id::varchar as result_uuid, coalesce(use_id::varchar, '') as message_uuid from last where result_id is not null""")
def live_sync_state(spark, sf_dir):
    """Clicks as uses and purchases as results, replayed by the live sync in two batches with one cursor."""
    from turnstore.streaming import live

    e = t(spark, sf_dir, "events").where("event_type in ('click', 'purchase')")
    use = F.format_string('{"type":"assistant","uuid":"%d","message":{"content":[{"type":"tool_use","id":"%d","name":"x","input":{}}]}}', "event_id", "user_id")
    result = F.format_string('{"type":"user","uuid":"%d","message":{"content":[{"type":"tool_result","tool_use_id":"%d","content":"y"}]}}', "event_id", "user_id")
    lines = e.select(F.lit("s").alias("session_id"), F.col("event_id").alias("line_no"), F.when(F.col("event_type") == "click", use).otherwise(result).alias("line"))
    segments, store = scratch(spark, "segments"), scratch(spark, "live")
    half = e.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    for part in (F.col("line_no") <= half, F.col("line_no") > half):
        lines.where(part).write.mode("append").json(segments)
        live.sync(spark, segments, store)
    return spark.read.parquet(f"{store}/tool_calls").select("tool_use_id", "result_uuid", "message_uuid")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
