"""The operators as queries over whole tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statline.llm import (
    cover_tree_search,
    curriculum_mix,
    fill_in_middle,
    language_id,
    periodic_runs,
    projection_search,
    run_length_dedup,
    secret_scan,
    sentencepiece_codec,
    simhash_dedup,
    token_count,
    toxicity,
    url_filter,
)
from statline.llm.common import table

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; listed are the canonical URLs that more than one page carries."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.seen_again(pages), RULES)


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs).select("doc_id", "n_tokens", "score")


def op3_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_length_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "position")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, and what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_and_decode(docs).select("doc_id", "ids", "decoded")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's output by its digest, and the digest of what is restored from the output."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    moved = fill_in_middle.fill_in_middle(docs).drop("text")
    return fill_in_middle.restore_text(moved).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("fim", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's nearest language; those too far from its centroids are marked."""
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every text, after one text in ten has got a repeated tail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.find_runs(periodic_runs.with_repeated_tails(docs))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[n].cast("string") for n in (
        "start", "length", "period")]), F.lit("\n")))
    best = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_token_count, op3_top_k_search, op4_suffix_dedup, op5_nearest_neighbours,
        op6_secret_scan, op7_source_mix, op8_simhash_dedup, op9_sentencepiece, op10_toxicity,
        op11_fill_in_middle, op12_language_id, op13_periodic_runs,
    )
}

_URL_PARTS = r"""
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)'))) AS kept
  FROM pages"""


def _rule_cases() -> tuple[str, str]:
    rule = verdict = ""
    for decision, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):  # stable: the first of equals
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        rule += f" WHEN {fits} THEN '{host}{path}'"
        verdict += f" WHEN {fits} THEN '{decision}'"
    return f"CASE{rule} END", f"CASE{verdict} WHEN is_listed THEN 'block' ELSE 'allow' END"


_FIM_UNITS = r"""
  SELECT doc_id, text, units, len(units) AS n, regexp_matches(text, '<[PSM]>') AS marked,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || digest[i:i + 7] AS BIGINT)) AS h
  FROM (SELECT doc_id, coalesce(text, '') AS text,
          regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
          sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
        FROM documents)"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": f"""
WITH parts AS ({_URL_PARTS}),
forms AS (
  SELECT page_id, host, path, CASE WHEN host <> '' THEN
    regexp_replace(host, ':(80|443)?$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' ELSE '' END || array_to_string(kept, '&') END AS canonical
  FROM parts),
marked AS (
  SELECT *, canonical IS NOT NULL AND count(*) OVER (PARTITION BY canonical) > 1 AS is_listed FROM forms)
SELECT page_id, host, path, canonical, {_rule_cases()[0]} AS rule, {_rule_cases()[1]} AS verdict, is_listed
FROM marked""",
    "op3_top_k_search": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored) WHERE rank <= 5""",
    "op11_fill_in_middle": f"""
WITH cuts AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b
  FROM ({_FIM_UNITS})),
parts AS (
  SELECT doc_id, text, n, array_to_string(units[:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
    array_to_string(units[b + 1:], '') AS s,
    CASE WHEN text = '' OR marked OR h[3] % 100 >= 100 THEN 'plain'
         WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cuts)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts""",
}
