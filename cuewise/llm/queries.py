"""One query for each operator of this subpackage, with its production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.llm import decontamination, fingerprint, hmm, language_id, mixing, pii, sharding, simhash, spelling, top_k, toxicity, url_filter, whitening
from cuewise.llm.common import documents, table
from cuewise.sources.tables import spread

#: The test tables have no list of URLs: the query lists those pages that it finds on these hosts.
LISTED_HOSTS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op1_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(documents(spark, sf_dir))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(url_filter.url_host(F.col("url")).rlike(rf"(^|\.)({'|'.join(LISTED_HOSTS)})\.")).select("url")
    return url_filter.filter_urls(pages, listed)


def op3_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_exact_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(documents(spark, sf_dir))


def op6_lsi_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).drop("text_hash")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(documents(spark, sf_dir))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(spread(table(spark, sf_dir, "embeddings")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spread(table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP2_SQL = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
k AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '(/|\.html)+$', '') END AS key FROM p),
l AS (SELECT DISTINCT key FROM k WHERE regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.')),
r AS (
  SELECT page_id, host, path, key IN (SELECT key FROM l WHERE key IS NOT NULL) AS hit,
    CASE
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
    END AS rule
  FROM k)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN coalesce(hit, false) THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(hit, false) AS listed
FROM r
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
e AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)
      / greatest(0.05::DOUBLE, length(regexp_replace(t, '[^\p{L}]+', '', 'g'))::DOUBLE / greatest(length(t), 1)) AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM e GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS goal, sum(w) OVER () AS ww FROM s),
l AS (SELECT *, (goal - coalesce(sum(cap) OVER b, 0)) / (ww - coalesce(sum(w) OVER b, 0)) AS level FROM c
  WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, round(coalesce(least(cap, w * (SELECT arg_min(level, cap / w) FROM l WHERE level * w <= cap)), cap), 6) AS target FROM l),
r AS (
  SELECT e.doc_id, e.source, e.size, t.source_size, t.target,
    sum(e.size) OVER (PARTITION BY e.source ORDER BY e.key, e.doc_id ROWS UNBOUNDED PRECEDING) - e.size AS ahead,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs
  FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, target - epochs * source_size AS budget FROM r)
SELECT doc_id, source, size, source_size, target,
  (size * epochs + greatest(0, least(size, round(budget)::BIGINT - ahead)))::BIGINT AS taken,
  (CASE WHEN size > 0 THEN epochs + (2 * ahead + size <= 2 * budget)::INT ELSE 0 END)::BIGINT AS copies
FROM f
"""


OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op8_source_mixing": OP8_SQL, "op11_ball_tree_top_k": OP11_SQL}
