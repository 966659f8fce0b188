"""The dealt operators as named queries over the test tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from complyframe.llm import (
    alignment,
    bpe,
    exact,
    jaccard,
    lexical,
    licences,
    ngram,
    packing,
    rules,
    sharding,
    simhash,
    urls,
    warc,
)

SHARDS = [(n, 1.0) for n in range(40)]
GROWN = (40, 1.0)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    at = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(_table(spark, folder, "documents"), at, public_tokenizers.PATTERN)
    both = bpe.decode(ids, at, public_tokenizers.PATTERN)
    return both.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256")


def op2_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign(_table(spark, folder, "documents"), SHARDS, GROWN)
    return placed.selectExpr("doc_id", "size", "text_crc32", "'key' AS law", "shard", "slot", "grown_shard")


def op3_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(_table(spark, folder, "documents"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(_table(spark, folder, "documents"))


def op6_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"))


def op7_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"))


def op9_bin_completion(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_ngram_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ngram.scores(_table(spark, folder, "documents"))


def op11_jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_sets(_table(spark, folder, "documents"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(_table(spark, folder, "documents"), a, b)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_rendezvous_shards,
        op3_licence_scan,
        op4_exact_dedup,
        op5_quality_rules,
        op6_warc_round_trip,
        op7_simhash_components,
        op8_url_filter,
        op9_bin_completion,
        op10_ngram_scores,
        op11_jaccard_components,
        op12_lexical_search,
        op13_token_alignment,
    )
}


def _unescaped_sql(x: str) -> str:
    hexadecimal = "CAST('0x' || p[4:-2] AS BIGINT)"
    code = f"CASE WHEN regexp_matches(p, '^&#[0-9]+;$') THEN CAST(p[3:-2] AS INTEGER) WHEN regexp_matches(p, '^&#[xX][0-9a-fA-F]+;$') THEN {hexadecimal} END"
    named = "WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '\"' WHEN '&apos;' THEN chr(39)"
    whole = f"CASE WHEN ({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111 THEN chr(CAST({code} AS INTEGER)) ELSE CASE p {named} ELSE p END END"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(?s)&#[0-9]{{1,7}};|&#[xX][0-9a-fA-F]{{1,6}};|&[a-z]+;|[^&]+|&'), lambda p: {whole}), '')"


def _without_dots_sql(path: str) -> str:
    step = "CASE s WHEN '.' THEN a WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END"
    return f"list_reduce(string_split(regexp_replace({path}, '/(\\.\\.?)$', '/\\1/'), '/'), lambda a, s: {step})"


def _node_sql(url: str) -> str:
    site = f"translate(regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}')"
    path, query = (f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)([^#]*)', {k})" for k in (1, 2))
    return f"{site} || {_without_dots_sql(path)} || {query}"


def _resolved_sql(url: str, link: str) -> str:
    return f"""CASE
    WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {link}
    WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN {link} LIKE '#%' THEN {url}
    WHEN {link} LIKE '//%' THEN regexp_extract({url}, '(?s)^(.*?)://', 1) || ':' || {link}
    WHEN {link} LIKE '/%' THEN regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1) || {link}
    WHEN {link} LIKE '?%' THEN regexp_extract({url}, '(?s)^(.*?://[^?#]*)', 1) || {link}
    ELSE regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*/)', 1), ''), '/') || {link}
  END"""


ORACLES: dict[str, str] = {
    "op12_lexical_search": lexical.SEARCH_SQL,
    "op3_licence_scan": licences.scan_sql(),
    "op4_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY n)""",
    "op6_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
l AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS latest FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM l""",
    "op8_url_filter": rf"""
WITH RECURSIVE rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
),
tag AS (
  SELECT url, {_unescaped_sql("""regexp_extract(html, '(?is)<base\\b[^>]*?\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)""")} AS based,
    unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')
),
link AS (
  SELECT url, based, CASE
    WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1)
  END AS link FROM tag
),
whole AS (
  SELECT url, CASE WHEN based <> '' THEN {_resolved_sql("url", "based")} END AS based, {_unescaped_sql("link")} AS link FROM link WHERE link <> ''
),
start AS (SELECT url, CASE WHEN contains(based, '://') THEN based ELSE url END AS base, link FROM whole),
target AS (SELECT url, {_resolved_sql("base", "link")} AS target FROM start),
edge AS (SELECT {_node_sql("url")} AS src, {_node_sql("target")} AS dst FROM target WHERE contains(target, '://')),
both_ways AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge),
page AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, {_node_sql("url")} AS node
  FROM pages
),
spot AS (
  SELECT node, translate(regexp_extract(node, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(node, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT src AS node FROM both_ways)
),
own AS (
  SELECT p.host, p.path, r.host || r.path AS rule, r.verdict
  FROM (SELECT host, path FROM page UNION SELECT host, path FROM spot) p
  JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r.host || r.path) DESC, r.verdict) = 1
),
passed AS (
  SELECT s.node FROM spot s JOIN own o ON o.host = s.host AND o.path = s.path AND o.verdict = 'block'
  UNION
  SELECT b.dst FROM passed p JOIN both_ways b ON b.src = p.node
)
SELECT page_id, p.host, p.path, o.rule, coalesce(o.verdict, CASE WHEN p.node IN (SELECT node FROM passed) THEN 'block' END, 'allow') AS verdict
FROM page p LEFT JOIN own o ON o.host = p.host AND o.path = p.path""",
}
