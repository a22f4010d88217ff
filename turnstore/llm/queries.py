"""The registered queries of the training-data operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstore.llm import bpe, html_text, langid, media, packing, quality_rules, ranker, sharding, simhash, token_counts
from turnstore.llm.common import held_out, materialise, table

WORD_BPE, PIECES, BYTE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"
TOKEN_LIMIT = 4096


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ranker.fit(docs, table(spark, sf_dir, "labels"))
    scored = ranker.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured, name = quality_rules.with_measures(docs)
    measured = materialise(measured.drop("text"))
    judged, kept = quality_rules.judge(measured, name, quality_rules.cutoffs(measured, name, table(spark, sf_dir, "labels")))
    m = F.col(name)
    return judged.select("doc_id", *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), F.col(kept).alias("kept"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(PIECES), TOKEN_LIMIT).drop("text")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_ranking, op2_quality_rules, op3_language_id, op4_bpe_round_trip, op5_token_counts, op6_html_text, op7_simhash, op8_media_audio, op9_sharding, op10_packing, pipeline]
    return {f.__name__: f for f in found}


def _op2_sql() -> str:
    q = quality_rules
    space = r"\x20\x09-\x0D"
    bands = " ".join(f"when n_words >= {least} then {k}" for k, least in reversed([*enumerate(q.STRATA)]))
    grid = ", ".join(f"('{rule}', {c})" for rule, cs in q.RULES.items() for c in cs)
    values = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words", "stale": "n_stale"}
    long = ", ".join(f"1000 * {values[r]} // greatest(n_words, 1) as {r}" for r in values)
    return f"""
with w as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^{space}]+') as words from documents
), win as (
  select doc_id, row_number() over (partition by doc_id order by j) as i, x from (
    select doc_id, unnest(range(1, len(words) - {q.WINDOW - 2})) as j,
      unnest(list_transform(list_zip({", ".join(f"words[{k + 1}:len(words) - {q.WINDOW - 1 - k}]" for k in range(q.WINDOW))}), lambda z: hash(z))) as x
    from w where len(words) >= {q.WINDOW})
), again as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x) as n from win) where n > 1
), rep as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {q.WINDOW})) as p from again) group by doc_id
), base as (
  select w.doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]'))))::bigint as n_dup_lines,
    coalesce(rep.n, 0)::bigint as n_repeat_words,
    len(regexp_extract_all(t, '[A-Z]')) as n_upper, len(words) - len(list_distinct(words)) as n_stale
  from w left join rep on rep.doc_id = w.doc_id
), m as (
  select *, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words as base_failed, case {bands} end as stratum,
    {long}, 1000 * word_chars // greatest(n_words, 1) as word_chars_rate, 1000 * n_upper // greatest(word_chars, 1) as upper_rate
  from base
), v as (
  select doc_id, stratum, base_failed, unnest([{", ".join(f"{{'rule': '{r}', 'value': {dict(upper='upper_rate', word_chars='word_chars_rate').get(r, r)}}}" for r in q.RULES)}], recursive := true) from m
), lab as (
  select v.*, good from v join (select doc_id, min(quality) as good from labels where quality is not null group by doc_id) l on l.doc_id = v.doc_id where not base_failed
), tried as (
  select stratum, g.rule, cutoff, sum(good)::bigint as n, coalesce(sum(good) filter (value > cutoff), 0)::bigint as k, coalesce(sum(1 - good) filter (value > cutoff), 0)::bigint as bad
  from lab join (values {grid}) g(rule, cutoff) on g.rule = lab.rule group by all
), safe as (
  select * from tried where bad > {q.PRICE} * k and n > 0 and k < {q.ALPHA} * n
    and list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({q.ALPHA}) + (n - i) * ln(1 - {q.ALPHA})))) <= {q.DELTA} / {q.CHAINS}
), best as (
  select stratum, rule, cutoff from safe qualify row_number() over (partition by stratum, rule order by bad - {q.PRICE} * k desc, cutoff desc) = 1
), over_ as (
  select distinct v.doc_id from v join best on best.stratum = v.stratum and best.rule = v.rule where v.value > best.cutoff
)
select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and over_.doc_id is null as kept
from m left join over_ on over_.doc_id = m.doc_id
"""




def _op9_sql(shards: int = sharding.SHARDS) -> str:
    return f"""
with tab as (
  select list(c order by b) as tab from (
    with recursive r(b, k, c) as (
      select b, 0, b::bigint from range(256) x(b) union all
      select b, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384::bigint) else c // 2 end from r where k < 8
    ) select b, c from r where k = 8)
), bytes as (
  select doc_id, coalesce(strlen(text), 0)::bigint + 1 as size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint) as bs from documents
), sized as (
  select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, bs), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295::bigint) as text_crc32 from bytes, tab
), placed as (
  select *, sum(size) over w - size as before, sum(size) over () as total, row_number() over w as i
  from sized window w as (order by doc_id, text_crc32 rows unbounded preceding)
), cut as (
  select *, ((2 * before + size) * {shards} // (2 * total))::int as shard from placed
)
select doc_id, size, text_crc32, 'bytes' as law, shard, (i - min(i) over (partition by shard))::bigint as slot, null::int as grown_shard from cut
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _op2_sql(), "op9_sharding": _op9_sql()}
