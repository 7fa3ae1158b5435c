"""Registered queries of the corpus operators, with production parameters, and their SQL twins for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (bpe, decontamination, digest, fill_middle, html_extract, katz, lexical_search, license_scan, line_dedup, sharding, simhash, toxicity,
                          url_filter)
from tidemark.llm.common import table

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
TOXIC = 0.7
VOCABULARY = "byte_bpe_50k.tiktoken"
FILL_SEED = "7"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a NULL id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(map(str, URL_RULES)) + " as rules(host, path, verdict)")  # a local relation: no Python rows
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("n_lines").cast("bigint"), F.col("n_removed").cast("bigint"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity_model(spark, docs, sf_dir), "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def with_tokens(docs: DataFrame) -> DataFrame:
    """``docs`` with ids and decoded bytes by the query's vocabulary."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    return bpe.encode_and_decode(docs, path, pattern)


def token_digests() -> list[Column]:
    return [F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256")]


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *token_digests())


def digest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_neighbours(table(spark, sf_dir, "documents"))


def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"), "doc_id")
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])

    def names(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("spans")).alias("labels"),
                        F.when(F.col("n_words") > 0, F.col("n_covered") / F.col("n_words")).otherwise(0.0).alias("score"))


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint"), F.lit(None).cast("int").alias("grown_shard"))


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", F.col("n_shingles").cast("bigint"), F.col("n_found").cast("bigint"), "containment")


def katz_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = katz.score_corpus(table(spark, sf_dir, "documents"), ~held)
    return scored.rows.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def fill_middle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.restore(fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), FILL_SEED))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_url_filter": url_filter_query,
    "op2_line_dedup": line_dedup_query,
    "op3_toxicity": toxicity_query,
    "op4_simhash": simhash_query,
    "op5_byte_bpe": bpe_query,
    "op6_fingerprints": digest_query,
    "op7_license_scan": license_query,
    "op8_html_text": html_query,
    "op9_sharding": sharding_query,
    "op10_decontamination": decontamination_query,
    "op11_katz": katz_query,
    "op12_fill_middle": fill_middle_query,
    "op13_lexical_search": search_query,
}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_WORDS_SQL = r"list_filter(string_split_regex(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_TERMS_SQL = rf"list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical_search.SEPARATORS}'), lambda w: w <> '')"

ORACLES = {
    "op1_url_filter": rf"""
with rules(rhost, rpath, rverdict) as (values {_RULES_SQL}),
rests as (select page_id, row_number() over () as n, case when url is null or position('://' in url) = 0 then '' else substr(url, position('://' in url) + 3) end as rest from pages),
parts as (select page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from rests),
fits as (select n, rhost || rpath as rule, rverdict, row_number() over (partition by n order by length(rhost || rpath) desc) as k
         from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(rverdict, 'allow') as verdict from parts left join (select * from fits where k = 1) using (n)
""",
    "op2_line_dedup": rf"""
with docs as (select row_number() over () as n, doc_id, text, coalesce('s' || source, 'n') as site from documents),
lines as (select n, doc_id, site, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as pos from docs),
trimmed as (select *, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) as line from lines),
counted as (select *, regexp_matches(line, '^\S+(\s+\S+){{{line_dedup.MIN_WORDS - 1}}}') as counts from trimmed),
wide as (select line, min((doc_id, pos)) as first from counted where counts group by line having count(distinct site) >= {line_dedup.MIN_SITES}),
marked as (select n, pos, raw, counts and first is not null and first <> (doc_id, pos) as gone from counted left join wide using (line)),
built as (select n, string_agg(raw, chr(10) order by pos) filter (not gone) as kept, count(*) as n_lines, count(*) filter (gone) as n_removed from marked group by n)
select doc_id, case when text is null then null else coalesce(kept, '') end as text, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed
from docs left join built using (n)
""",
    "op10_decontamination": rf"""
with item_words as (select distinct item_id, text, {_WORDS_SQL} as ws from benchmark where text is not null),
item_shingles as (select distinct item_id, text, least(len(ws), {decontamination.SHINGLE}) as k, unnest(list_transform(range(1, len(ws) - least(len(ws), {decontamination.SHINGLE}) + 2),
                      lambda i: array_to_string(ws[i:i + least(len(ws), {decontamination.SHINGLE}) - 1], ' '))) as sh from item_words where len(ws) > 0),
item_sizes as (select item_id, text, count(*) as n from item_shingles group by item_id, text),
doc_words as (select doc_id, text, {_WORDS_SQL} as ws from documents where text is not null),
doc_shingles as (select doc_id, text, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as sh
                 from doc_words, (select distinct k from item_shingles) where len(ws) >= k)
select doc_id, i.item_id, n as n_shingles, count(distinct sh) as n_found, count(distinct sh) / n as containment
from doc_shingles d join item_shingles i using (k, sh) join item_sizes s on s.item_id is not distinct from i.item_id and s.text = i.text
group by doc_id, d.text, i.item_id, i.text, n having count(distinct sh) >= ceil({decontamination.CONTAINMENT} * n - 1e-9)
""",
    "op12_fill_middle": r"""
with rows as (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(doc_id::varchar, '')) as d from documents),
drawn as (select *, len(u) as n, ('0x' || substr(d, 1, 8))::bigint as h1, ('0x' || substr(d, 9, 8))::bigint as h2, ('0x' || substr(d, 17, 8))::bigint as h3, ('0x' || substr(d, 25, 8))::bigint as h4 from rows),
cut as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
               least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from drawn),
parts as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from cut)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256 from parts
""",
    "op13_lexical_search": rf"""
with docs as (select row_number() over () as r, doc_id, {_TERMS_SQL} as ws from documents),
lens as (select r, doc_id, len(ws) as n from docs where len(ws) > 0),
totals as (select count(*) as nn, sum(n)::bigint as ll from lens),
tfs as (select r, w, count(*) as tf from (select r, unnest(ws) as w from docs) group by r, w),
dfs as (select w, count(*) as df from tfs group by w),
items as (select distinct item_id, text from benchmark),
item_terms as (select distinct item_id, text, w from (select item_id, text, unnest({_TERMS_SQL}) as w from items)),
scores as (select item_id, text, doc_id, r, sum(floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score
           from item_terms join dfs using (w) join tfs using (w) join lens using (r), totals group by item_id, text, doc_id, r)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as rank from scores where score > 0) where rank <= {lexical_search.TOP}
""",
}
