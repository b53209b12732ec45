"""Evaluation: vectors, segmentations, tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import embeddings
from ..operators.registry import Registry
from . import sqltext as S

query = Registry()


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(
    "SELECT a.vec_id AS a, b.vec_id AS b, round(CASE WHEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) IS NULL OR isnan(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) THEN 0 ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
)
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every vector and the next."""
    e = _t(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(embeddings.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(
    "SELECT query, neighbour, place FROM (SELECT q.vec_id AS query, v.vec_id AS neighbour, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id)::INT AS place FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE place <= 5"
)
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest vectors of every vector whose id is divisible by 20, against all."""
    e = _t(spark, d, "embeddings")
    return embeddings.neighbours(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5).select("query", "neighbour", "place")


@query(
    "SELECT l_returnflag AS category, count(*)::BIGINT AS n, round(corr(ra, rb), 6) AS spearman FROM (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS rb FROM lineitem) GROUP BY 1"
)
def spearman_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Spearman correlation by category."""
    return embeddings.spearman(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag").select(F.col("l_returnflag").alias("category"), "n", F.round("spearman", 6).alias("spearman"))


@query()
def analogy_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Analogy accuracy over the pairs of neighbouring ids of each label, all rows, the answers sought among all vectors.

    The last row of a label with an odd number of rows has no pair; it is a candidate like all others.
    """
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("category"))
    place = F.floor((F.row_number().over(Window.partitionBy("category").orderBy("id")) - 1) / 2)
    pairs = e.select("id", "category").withColumn("pos", place).groupBy("category", "pos").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("ids")).filter("ids = 2")
    return embeddings.analogies(pairs, e.select("id", "vec"))


_PIECES = "(length(x) + 3) // 4"


@query(
    f"SELECT coalesce(script, 'ALL') AS script, sum(words)::BIGINT AS words, sum(pieces)::BIGINT AS pieces, round(sum(pieces) / sum(words), 6) AS fertility FROM (SELECT {S.two_class('text', S.AR_NARROW, 'a-zA-Z', 'other')} AS script, len({S.words('text')}) AS words, list_sum(list_transform({S.words('text')}, lambda x: {_PIECES})) AS pieces FROM documents WHERE len({S.words('text')}) > 0) GROUP BY ROLLUP (script)"
)
def fertility_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Pieces a word by script with a total row; pieces are chunks of four characters."""
    n = F.aggregate(T.words(F.col("text")), F.lit(0).cast("bigint"), lambda s, x: s + F.floor((F.length(x) + 3) / 4))
    x = _t(spark, d, "documents").filter(T.word_count(F.col("text")) > 0).select(T.script_narrow(F.col("text")).alias("script"), T.word_count(F.col("text")).alias("words"), n.alias("pieces"))
    g = x.rollup("script").agg(F.sum("words").alias("words"), F.sum("pieces").alias("pieces"))
    return g.select(F.coalesce("script", F.lit("ALL")).alias("script"), "words", "pieces", F.round(F.col("pieces") / F.col("words"), 6).alias("fertility"))


@query(f"SELECT round(sum(cost) / (sum(chars) + sum(words)), 6) AS compression_factor FROM (SELECT list_sum(list_transform(w, lambda x: {_PIECES})) AS cost, list_sum(list_transform(w, lambda x: length(x))) AS chars, len(w) AS words FROM (SELECT {S.words('text')} AS w FROM documents) WHERE len(w) > 0)")
def compression_factor(spark: SparkSession, d: str) -> DataFrame:
    """Cost of the pieces against characters and words."""
    w = T.words(F.col("text"))
    zero = F.lit(0).cast("bigint")
    x = _t(spark, d, "documents").select(
        F.aggregate(w, zero, lambda s, x: s + F.floor((F.length(x) + 3) / 4)).alias("cost"), F.aggregate(w, zero, lambda s, x: s + F.length(x)).alias("chars"), F.size(w).alias("words")
    )
    return x.filter("words > 0").agg(F.round(F.sum("cost") / (F.sum("chars") + F.sum("words")), 6).alias("compression_factor"))


@query()
def tokenizer_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Public tokenizers beside each other: pieces, fertility, compression and round-trip mismatches by tokenizer."""
    from ..operators import tokenizers

    return tokenizers.compare(_t(spark, d, "documents"), "text")


QUERIES, ORACLES = query.queries, query.oracles
