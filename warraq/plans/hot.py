"""Queries of problem 6: a few keys holding most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hotkeys

_SIDES = {"channel": ("youtube_comments", "channel", "video_id"), "subforum_id": ("forum_posts", "subforum_id", "thread_id")}
PROBS = (0.25, 0.5, 0.9)


def _side(spark: SparkSession, d: str, field: str) -> tuple[DataFrame, str, str]:
    table, key, item = _SIDES[field]
    return spark.read.parquet(f"{d}/{table}.parquet"), key, item


def _results(spark: SparkSession, d: str, field: str) -> DataFrame:
    df, key, item = _side(spark, d, field)
    return hotkeys.per_key(df, key, item, "text", "scrape_date")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys that hold at least 3 % of their table's rows, by refined histograms of their hashes."""
    parts = []
    for f in _SIDES:
        df, key, _ = _side(spark, d, f)
        parts.append(hotkeys.heavy_keys(df, key).select(F.lit(f).alias("field"), F.col("key_value").cast("string").alias("key_value")))
    return parts[0].unionByName(parts[1])


def p6_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct videos or threads, characters and latest scrape date of every key."""
    parts = [_results(spark, d, f).withColumn("field", F.lit(f)) for f in _SIDES]
    return parts[0].unionByName(parts[1]).select("field", "key_value", "records", "items", "chars", "latest")


def p6_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of the text length of every key."""
    parts = []
    for f in _SIDES:
        df, key, _ = _side(spark, d, f)
        parts.append(hotkeys.quantiles(df, key, F.length("text"), PROBS).withColumn("field", F.lit(f)))
    return parts[0].unionByName(parts[1]).select("field", "key_value", "prob", "n", "value")


QUERIES = {"p6_found": p6_found, "p6_per_key": p6_per_key, "p6_quantiles": p6_quantiles}

_PER_KEY = """
SELECT '{f}' AS field, {k} AS key_value, count(*)::BIGINT AS records, count(DISTINCT {i})::BIGINT AS items,
       coalesce(sum(length(text)), 0)::BIGINT AS chars, max(scrape_date) AS latest
FROM {t} GROUP BY {k}"""
_FOUND = """
SELECT '{f}' AS field, {k} AS key_value FROM {t} WHERE {k} IS NOT NULL GROUP BY {k}
HAVING count(*) >= 0.03 * (SELECT count(*) FROM {t})"""
_QUANT = """
SELECT '{f}' AS field, key_value, prob, n, value FROM (
  SELECT {k} AS key_value, length(text)::BIGINT AS value, prob,
         row_number() OVER (PARTITION BY {k}, prob ORDER BY length(text)) AS r,
         count(*) OVER (PARTITION BY {k}, prob) AS n
  FROM {t}, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) p(prob) WHERE text IS NOT NULL)
WHERE r = greatest(1, ceil(prob * n))"""


def _both(sql: str) -> str:
    return " UNION ALL ".join(sql.format(f=f, t=t, k=k, i=i) for f, (t, k, i) in _SIDES.items())


ORACLES = {"p6_found": _both(_FOUND), "p6_per_key": _both(_PER_KEY), "p6_quantiles": _both(_QUANT)}
