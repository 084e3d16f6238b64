"""The registered queries of the text operators and, where SQL can express them, their DuckDB counterparts."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, fingerprints, language_id, mixing, near_duplicates, private_data, quality, sharding, token_output, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.find_toxic(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_fingerprints(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find_private(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_shards(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_toxicity, op2_decontamination, op3_quality, op4_fingerprints, op5_mixing, op6_near_duplicates, op7_private_data, op8_sharding, op9_token_output, op10_language)
    return {f.__name__: f for f in ops}


_FOLDED = r"trim(regexp_replace(lower(text), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g'))"

_OP2 = rf"""
WITH items AS (SELECT item_id, string_split({_FOLDED}, ' ') w FROM benchmark WHERE {_FOLDED} <> ''),
 strings AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') s
             FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) i FROM items)),
 texts AS (SELECT DISTINCT doc_id, string_split({_FOLDED}, ' ') w FROM documents WHERE {_FOLDED} <> ''),
 held AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') s
          FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) i FROM texts))
SELECT doc_id, item_id, count(*) AS n_windows FROM held JOIN strings USING (s) GROUP BY ALL
"""

_OP5 = rf"""
WITH RECURSIVE
 docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')) n FROM documents),
 sums AS (SELECT source, sum(n)::BIGINT n FROM docs GROUP BY source HAVING sum(n) > 0),
 total AS (SELECT sum(n)::BIGINT t, count(*) k FROM sums),
 bisect(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN flat THEN (lo + hi) / 2 ELSE lo END, CASE WHEN flat THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (
         SELECT max(t * w / n) > {mixing.MAX_REPEATS} OR -sum(w * ln(w)) > {mixing.TARGET_ENTROPY} * ln(any_value(k))
         FROM (SELECT n, t, k, pow(n / t, (lo + hi) / 2) / sum(pow(n / t, (lo + hi) / 2)) OVER () w FROM sums, total)) flat
        FROM bisect WHERE i < {mixing.STEPS})),
 level AS (
  SELECT max(t * w / n) > {mixing.MAX_REPEATS} OR -sum(w * ln(w)) > {mixing.TARGET_ENTROPY} * ln(any_value(k)) flat
  FROM (SELECT n, t, k, 1.0 / k w FROM sums, total)),
 alpha AS (SELECT CASE WHEN (SELECT flat FROM level) AND (SELECT k FROM total) > 1 THEN hi ELSE 0 END a FROM bisect WHERE i = {mixing.STEPS}),
 quotas AS (
  SELECT source, n, (n + {mixing.BLOCK_TOKENS - 1}) // {mixing.BLOCK_TOKENS} blocks, floor(w * t + 0.5)::BIGINT q
  FROM (SELECT source, n, t, pow(n / t, a) / sum(pow(n / t, a)) OVER () w FROM sums, total, alpha)),
 placed AS (
  SELECT d.doc_id, d.source, d.n, q // s.n epochs, q % s.n rest,
         ('0x' || substr(md5('{mixing.SEED}|block|' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT % blocks AS block
  FROM docs d JOIN quotas s ON d.source IS NOT DISTINCT FROM s.source),
 passes AS (SELECT *, unnest(range(0, epochs + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) epoch FROM placed),
 keyed AS (
  SELECT *, ('0x' || substr(md5('{mixing.SEED}|' || epoch || '|' || coalesce(source, '') || '|' || block), 1, 15))::BIGINT block_order,
         ('0x' || substr(md5('{mixing.SEED}|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT turn
  FROM passes),
 drawn AS (SELECT *, sum(n) OVER (PARTITION BY source, epoch ORDER BY block_order, turn RANGE UNBOUNDED PRECEDING) upto FROM keyed)
SELECT doc_id, source, epoch, block, block_order FROM drawn WHERE epoch < epochs OR upto <= rest
"""

_OP8 = f"""
WITH sized AS (SELECT *, coalesce(strlen(text), 0) b FROM documents),
 totals AS (SELECT coalesce(sum(b), 0)::BIGINT t, greatest({sharding.MIN_SHARDS}, (coalesce(sum(b), 0)::BIGINT + {sharding.SHARD_BYTES - 1}) // {sharding.SHARD_BYTES}) n FROM sized),
 keys AS (SELECT doc_id, sum(sum(b)) OVER (ORDER BY doc_id NULLS FIRST) - sum(b) AS ahead FROM sized GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
       CASE WHEN t = 0 OR d.doc_id IS NULL THEN 0 ELSE least(n - 1, (ahead * n) // t) END::INTEGER AS shard
FROM documents d JOIN keys k ON d.doc_id IS NOT DISTINCT FROM k.doc_id, totals
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": _OP2, "op5_mixing": _OP5, "op8_sharding": _OP8}
