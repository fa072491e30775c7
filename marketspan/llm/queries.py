"""One query per operator over its whole table, with its fixed result columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_encoding, chat, decontamination, fill_in_middle, filter_audit, hmm, licenses, packing, quality, simhash, token_counts, token_file, url_filters

#: The rules that op5 judges by, as (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Fixed value: the conversation that op2 adds.
ADDED_TURNS = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]

#: What op13 appends to every text, and puts in place of its middle character.
APPENDED, EDITED = "'s last 42", " x'll "


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests_of(turns.union(spark.createDataFrame(ADDED_TURNS, "conv_id long, turn long, role string, text string")))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.written_documents(_table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json", end_id=0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_scores(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10, slop=1)
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json", end_id=1, length=2048)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_counts(_table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json", keep_steps=False, budget=1024, place=1000)
    return token_counts.over_limit(counts, 1024).select("doc_id", "n_bytes", "n_tokens", "over_limit", F.col("budget_chars").alias("chars_within_limit"), F.col("place_tokens").alias("tokens_of_1000_chars"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"), seed=42, percent=50, spm_percent=80)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", fill_in_middle.digests(F.col("output"), F.col("form")).alias("x")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "x.*")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _middle(text: str) -> tuple[int, int, str]:
    """op13's edit: the character in the middle gives way to another text."""
    return len(text) // 2, len(text) // 2 + 1, EDITED


def op13_byte_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_encoding.encode_documents(_table(spark, sf_dir, "documents"), ranks="byte_bpe_50k.tiktoken", decode=True, append=APPENDED, edit=_middle)
    digest = lambda c, name: F.sha2(c, 256).alias(name)
    return found.select("doc_id", "n_tokens", digest(F.col("ids"), "ids_sha256"), digest(F.col("decoded"), "decoded_sha256"), digest(F.col("appended_ids"), "appended_sha256"), digest(F.col("edited_ids"), "edited_sha256"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_chat, op3_token_file, op4_quality, op5_urls, op6_licenses, op7_hmm, op8_decontamination, op9_packing, op10_token_counts, op11_fill_in_middle, op12_filter_audit, op13_byte_encoding)}

#: The page's own rule decides on tables without links; the method's verdict for the rest is to allow.
_OP5 = r"""
with u as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), r(h, f, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (
  select page_id, host, path, h || f as rule, v, row_number() over (partition by page_id order by length(h || f) desc) as k
  from p left join r on (host = h or host like '%.' || h) and starts_with(path, f)
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict, cast(null as varchar) as alias_of from m where k = 1
"""

_OP11 = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, sha256('42:' || doc_id) as h from documents
), s as (
  select *, len(u) as n, ('0x' || substr(h, 1, 8))::ubigint % (len(u) + 1) as c1, ('0x' || substr(h, 9, 8))::ubigint % (len(u) + 1) as c2,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || substr(h, 17, 8))::ubigint % 100 >= 50 then 'plain'
      when ('0x' || substr(h, 25, 8))::ubigint % 100 < 80 then 'spm' else 'psm' end as form from d
), c as (
  select *, coalesce(array_to_string(u[1:least(c1, c2)::bigint], ''), '') as p, coalesce(array_to_string(u[least(c1, c2)::bigint + 1:greatest(c1, c2)::bigint], ''), '') as m,
    coalesce(array_to_string(u[greatest(c1, c2)::bigint + 1:n], ''), '') as x from s
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || x || '<M>' || m else '<S>' || x || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from c
"""

_OP12 = r"""
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id),
f as (
  select part, quality, toxic,
    case when len(ws) < 100 then 'A' else '' end || case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) then 'C' else '' end || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when min(doc_id) over (partition by t) < doc_id then 'E' else '' end as fails
  from w left join l using (doc_id)
), k(c) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
o as (
  select a.c || b.c || d.c || e.c || g.c as filter_order from k a, k b, k d, k e, k g
  where a.c <> b.c and a.c <> d.c and a.c <> e.c and a.c <> g.c and b.c <> d.c and b.c <> e.c and b.c <> g.c and d.c <> e.c and d.c <> g.c and e.c <> g.c
), r as (
  select f.*, filter_order, case when contains(fails, substr(filter_order, 1, 1)) then 1 when contains(fails, substr(filter_order, 2, 1)) then 2
    when contains(fails, substr(filter_order, 3, 1)) then 3 when contains(fails, substr(filter_order, 4, 1)) then 4
    when contains(fails, substr(filter_order, 5, 1)) then 5 else 6 end as leaves from f, o
), s as (
  select part, filter_order, cast(step as integer) as step, substr(filter_order, step, 1) as filter,
    count(*) filter (where leaves > step) as kept, count(*) filter (where leaves = step) as removed,
    count(*) filter (where leaves < step and contains(fails, substr(filter_order, step, 1))) as redundant,
    count(*) filter (where fails = substr(filter_order, step, 1)) as unique_fails,
    count(*) filter (where leaves = step and quality = 1) as good_lost, count(*) filter (where leaves = step and toxic = 1) as toxic_lost
  from r, unnest([1, 2, 3, 4, 5]) as x(step) group by all
)
select *, cast(sum(removed) over (partition by part, filter) as bigint) as shapley from s
"""

ORACLE_SQL = {"op5_urls": _OP5, "op11_fill_in_middle": _OP11, "op12_filter_audit": _OP12}
