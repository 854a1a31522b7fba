"""Queries of the pipeline operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_extract, line_dedup, mixing, near_dedup, packing, quality, secret_scan, token_store, toxicity
from .common import read_table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), counts=True)
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), num=85, den=100)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


#: Whole-table SQL of op7: targets by water-filling, seats as the highest quotients, epochs and a partial one.
MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS DOUBLE) AS cap FROM sized GROUP BY source),
weighted AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nr,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM sources),
filling AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * (SELECT CAST(sum(source_size) AS BIGINT) FROM sources)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate,
         row_number() OVER (ORDER BY cap / w, nr) AS k FROM weighted),
level AS (SELECT min(k) AS k, arg_min(rate, k) AS rate FROM filling WHERE w * rate <= cap),
targets AS (
  SELECT nr, source, source_size, CASE WHEN f.k >= l.k THEN f.w * l.rate ELSE cap END AS target FROM filling f, level l),
seats AS (
  SELECT nr, count(*) AS blocks FROM (
    SELECT nr, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, nr) AS place
    FROM targets, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(target / 16) AS BIGINT) + 2)) AS j))
  WHERE place <= (SELECT round_even(sum(target) / 16, 0) FROM targets) GROUP BY nr),
shards AS (
  SELECT t.nr, substr(digest, 1, 2) AS shard, CAST(sum(size) AS BIGINT) AS words, any_value(blocks) AS blocks
  FROM sized JOIN targets t ON sized.source IS NOT DISTINCT FROM t.source JOIN seats ON seats.nr = t.nr GROUP BY 1, 2),
quotas AS (
  SELECT nr, shard, any_value(words) AS words, least(2 * any_value(words), 16 * sum(CAST(place <= blocks AS BIGINT))) AS quota FROM (
    SELECT s.nr, shard, words, blocks, row_number() OVER (PARTITION BY s.nr ORDER BY CAST(words AS DOUBLE) / (2 * j + 1) DESC, shard) AS place
    FROM shards s JOIN targets t ON t.nr = s.nr,
         LATERAL (SELECT unnest(generate_series(0, CAST(ceil(blocks * words / source_size) AS BIGINT) + 2)) AS j) WHERE words > 0)
  GROUP BY nr, shard),
placed AS (
  SELECT s.*, t.nr, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY t.nr, substr(digest, 1, 2) ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN words > 0 THEN (quota // words) * size + greatest(0, least(size, quota % words - before)) ELSE 0 END AS BIGINT) AS taken
FROM placed p LEFT JOIN quotas q ON q.nr = p.nr AND q.shard = substr(digest, 1, 2)
"""

#: Whole-table SQL of op8: all pairs that share a shingle, then the smallest document reachable.
NEAR_DEDUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM words, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (
  SELECT doc_id AS origin, doc_id AS seen FROM words UNION SELECT origin, b FROM reach JOIN links ON seen = a)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id JOIN (SELECT origin, min(seen) AS component_id FROM reach GROUP BY origin) r ON r.origin = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the others are tested against brute force."""
    return {"op7_mixing": MIXING_SQL, "op8_near_dedup": NEAR_DEDUP_SQL}
