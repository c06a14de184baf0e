"""Registered queries of this package: thin calls of the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lattiq import scratch

from . import base, chroma, dac, neardup, ordermin, packing, pii, substrings, tokens, toxicity, warc


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(base.documents(spark, sf_dir), tokenizer_path())


def op10_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read(dac.write(base.documents(spark, sf_dir), tokenizer_path(), end_id=2))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def pseudonym_key(spark: SparkSession) -> bytes:
    """The secret of the pseudonyms: from the session, with a fixed one for tests."""
    return spark.conf.get("lattiq.pii.key", "a key for tests only").encode()[:64]


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(base.documents(spark, sf_dir), pseudonym_key(spark), count="n_replaced")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(base.documents(spark, sf_dir))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(base.documents(spark, sf_dir), window=20)


def op4_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classified(base.documents(spark, sf_dir), k=4, percent=80)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.compared(base.documents(spark, sf_dir))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.recrawl(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "canonical", "target_id", "status", F.array_join(lines, "\n").alias("headers"))


def op6_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    values = scratch.written(chroma.filter_values(chroma.tunes(vectors)), "filters")  # the sound is worked on once
    out = chroma.align(chroma.packed(values, chroma.levels_of(values)), lambda media_id: media_id % 50 == 0)
    scratch.dropped(values)  # the codes are written by now
    return out


QUERIES = {
    "op3_warc_revisits": op3_warc_revisits,
    "op6_chroma_fingerprints": op6_chroma_fingerprints,
    "op5_order_minhash": op5_order_minhash,
    "op4_bottom_k_near_dedup": op4_bottom_k_near_dedup,
    "op1_substring_dedup": op1_substring_dedup,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op7_toxicity": op7_toxicity,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_forced_boundary_bpe": op9_forced_boundary_bpe,
    "op10_addressable_codes": op10_addressable_codes,
}
ORACLE_SQL: dict[str, str] = {
    "op3_warc_revisits": """
with r as (
  select page_id i, url, md5(coalesce(html, '')) tag, length(coalesce(html, '')) n from pages
), c as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') host_path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p:
      p <> '' and not starts_with(lower(split_part(p, '=', 1)), 'utm_') and lower(split_part(p, '=', 1)) not in ('ref', 'fbclid', 'gclid', 'sessionid'))), '&') params
  from r
), k as (select *, host_path || case when params <> '' then '?' || params else '' end canonical from c),
v as (select *, 10 * i + 5 + i % 7 * 1000 ts from k),
j as (
  select v.i, v.canonical, v.ts, v.tag, max(x.i) filter (10 * x.i < v.ts) target from v join k x on x.canonical = v.canonical group by all
)
select 2 * j.i + 1 record_id, j.canonical,
  case when j.target is not null and j.i % 10 <> 0 and x.tag = j.tag then 2 * j.target end target_id,
  case when j.target is null then 'missing' when j.i % 10 <> 0 and x.tag = j.tag then 'resolved' else 'changed' end status,
  case when j.target is not null and j.i % 10 <> 0 and x.tag = j.tag then 'cache-control: max-age=60\ncontent-length: ' || x.n
    || '\ncontent-type: text/html\ndate: ' || j.ts || '\netag: "' || x.tag || '"' end headers
from j left join k x on x.i = j.target""",
    "op1_substring_dedup": """
with words as (
  select doc_id, generate_subscripts(ws, 1) pos, unnest(ws) word
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents)
), windows as (
  select doc_id, pos, word, count(*) over w n, string_agg(word, ' ') over w window20 from words
  window w as (partition by doc_id order by pos rows between current row and 19 following)
), judged as (
  select doc_id, pos, word, n = 20 and row_number() over (partition by n, window20 order by doc_id, pos) > 1 repeated from windows
), covered as (
  select doc_id, pos, word, bool_or(repeated) over (partition by doc_id order by pos rows between 19 preceding and current row) gone from judged
), kept as (
  select doc_id, count(*) n, count(*) filter (gone) g, string_agg(word, ' ' order by pos) filter (not gone) k from covered group by doc_id
)
select doc_id, coalesce(n, 0) n_words, coalesce(g, 0) n_removed, sha256(coalesce(k, '')) kept_sha256 from documents left join kept using (doc_id)""",
    "op4_bottom_k_near_dedup": """
with recursive words as (
  select doc_id, generate_subscripts(ws, 1) pos, unnest(ws) word, len(ws) n_words
  from (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws from documents)
), runs as (
  select doc_id, pos, n_words, count(*) over w n, string_agg(word, ' ') over w shingle from words
  window w as (partition by doc_id order by pos rows between current row and 3 following)
), shingles as (select distinct doc_id, shingle from runs where n = 4 or n_words < 4 and pos = 1),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
shared as (select a.doc_id a, b.doc_id b, count(*) n from shingles a join shingles b using (shingle) where a.doc_id <> b.doc_id group by all),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), reached(doc_id, other) as (
  select doc_id, doc_id from documents union select doc_id, b from reached join links on a = other
), components as (select doc_id, min(other) component_id from reached group by doc_id)
select doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept from components left join sizes using (doc_id)""",
}
