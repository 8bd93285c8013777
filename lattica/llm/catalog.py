"""The queries of this subpackage, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality
from .common import documents
from .decontamination import find_leaks
from .exact_dedup import lsm_dedup
from .language_id import fold
from .mixing import mix
from .pii import find_pii
from .pseudo_likelihood import pseudo_likelihood
from .secrets import find_secrets
from .simhash import simhash_components
from .substring_dedup import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "position")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm_dedup(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.identify(docs, language_id.learn(docs, fold(4) == 2))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    docs = documents(spark, sf_dir)
    found = quality.score(docs, quality.learn(docs, labels.where(fold(5) != 0)))
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_pii, op2_mixing, op3_decontamination, op4_simhash, op5_exact_dedup, op6_secrets, op7_pseudo_likelihood, op8_substring_dedup, op9_language_id, op10_quality)}


_WORD = r"[^ \t\n\x0B\f\r]+"

OP2 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sources),
weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         CASE rank % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN -0.8::DOUBLE ELSE 0.8::DOUBLE END AS slope
  FROM ranked),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / weight AS ratio,
         1.5::DOUBLE * sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight
  FROM weighed),
passed AS (
  SELECT *, (total - coalesce(sum(lim) OVER w, 0)) / (all_weight - coalesce(sum(weight) OVER w, 0)) AS own_level
  FROM levels
  WINDOW w AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min(own_level, (ratio, rank)) AS level FROM passed WHERE own_level <= ratio),
targets AS (
  SELECT p.source, p.source_size, p.slope,
         CASE WHEN l.level IS NULL OR l.level > p.ratio THEN p.lim ELSE l.level * p.weight END AS target
  FROM passed p, level l),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.slope, round(t.target)::BIGINT AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (
  SELECT *, least(greatest(whole - start, 0), size) + least(greatest(whole - source_size - start, 0), size) AS taken
  FROM placed)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN
         CASE WHEN start / target <= 0 THEN 0.0::DOUBLE
              ELSE 2.0::DOUBLE * (start / target)
                   / ((1.0::DOUBLE - slope) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope)
                                           + 4.0::DOUBLE * slope * (start / target))) END
       END AS position
FROM mixed
"""

OP5 = r"""
WITH rows_ AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM rows_
"""

OP8 = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS body
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM words WHERE len(w) >= 20)),
again AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS body, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words) x
  LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i
  WHERE g.i IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.body, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2, "op5_exact_dedup": OP5, "op8_substring_dedup": OP8}
