"""Vocabulary: terms and bigrams by source, coverage, hapaxes, overlap, n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ngram
from ..operators.registry import Registry
from . import profile
from . import sqltext as S

query = Registry()


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Comments and posts as two sources (source, id, text)."""
    c = spark.read.parquet(f"{d}/youtube_comments.parquet").select(F.lit("youtube").alias("source"), F.col("row_id").alias("id"), "text")
    p = spark.read.parquet(f"{d}/forum_posts.parquet").select(F.lit("djelfa").alias("source"), F.col("row_id").alias("id"), "text")
    return c.unionByName(p).filter("text is not null")


_SRC = "(SELECT 'youtube' AS source, row_id AS id, text FROM youtube_comments UNION ALL SELECT 'djelfa', row_id, text FROM forum_posts)"
_UNI = f"""SELECT token, count(*)::BIGINT AS total_count, count(*) FILTER (source = 'youtube')::BIGINT AS youtube_count, count(*) FILTER (source = 'djelfa')::BIGINT AS djelfa_count,
  count(DISTINCT source || ':' || id)::BIGINT AS doc_count FROM (SELECT source, id, unnest({S.vocabulary('text')}) AS token FROM {_SRC} WHERE text IS NOT NULL) GROUP BY token"""


def unigrams(spark: SparkSession, d: str) -> DataFrame:
    """(token, total_count, youtube_count, djelfa_count, doc_count): one shuffle of (token, partial counts)."""
    tokens = sources(spark, d).select("source", "id", T.vocabulary_tokens(F.col("text")).alias("w"))
    return ngram.counts_by_source(tokens, "w", "token")


@query(_UNI)
def vocab_unigrams(spark: SparkSession, d: str) -> DataFrame:
    """Term and document frequency by source."""
    return unigrams(spark, d)


@query(
    f"""SELECT bigram, count(*)::BIGINT AS total_count, count(*) FILTER (source = 'youtube')::BIGINT AS youtube_count, count(*) FILTER (source = 'djelfa')::BIGINT AS djelfa_count,
  count(DISTINCT source || ':' || id)::BIGINT AS doc_count FROM (SELECT source, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram
  FROM (SELECT source, id, {S.vocabulary('text')} AS w FROM {_SRC} WHERE text IS NOT NULL)) GROUP BY bigram"""
)
def vocab_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """Bigram and document frequency by source."""
    tokens = sources(spark, d).select("source", "id", T.vocabulary_tokens(F.col("text")).alias("v")).select("source", "id", ngram.joined_ngrams(F.col("v"), 2).alias("w"))
    return ngram.counts_by_source(tokens, "w", "bigram")


@query(
    f"""WITH u AS ({_UNI}), c AS (SELECT row_number() OVER (ORDER BY total_count DESC, token) AS r, sum(total_count) OVER (ORDER BY total_count DESC, token) / (SELECT sum(total_count) FROM u) AS share FROM u)
SELECT 0.5::DOUBLE AS target, min(r)::BIGINT AS types FROM c WHERE share >= 0.5 UNION ALL SELECT 0.9, min(r)::BIGINT FROM c WHERE share >= 0.9"""
)
def vocab_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many of the most frequent terms cover half and nine tenths of all occurrences."""
    # Terms with the same count are interchangeable for a cumulative share, so counts of counts suffice: bounded by
    # the square root of the corpus, and one small window instead of one over all terms.
    by_count = unigrams(spark, d).groupBy("total_count").agg(F.count(F.lit(1)).alias("types"))
    w = Window.orderBy(F.desc("total_count")).rowsBetween(Window.unboundedPreceding, 0)
    upto = by_count.select(
        "total_count", "types", F.sum("types").over(w).alias("t"), F.sum(F.col("types") * F.col("total_count")).over(w).alias("s"), F.sum(F.col("types") * F.col("total_count")).over(Window.partitionBy()).alias("all")
    )
    before = F.col("s") - F.col("types") * F.col("total_count")
    parts = []
    for target in (0.5, 0.9):
        need = F.lit(target) * F.col("all")
        rank = F.col("t") - F.col("types") + F.greatest(F.lit(1), F.ceil((need - before) / F.col("total_count")))
        parts.append(upto.filter((F.col("s") >= need) & (before < need)).select(F.lit(target).alias("target"), rank.cast("bigint").alias("types")))
    return parts[0].unionByName(parts[1])


@query(
    f"""WITH u AS ({_UNI}) SELECT CASE WHEN youtube_count > 0 AND djelfa_count > 0 THEN 'shared' WHEN youtube_count > 0 THEN 'youtube_only' ELSE 'djelfa_only' END AS overlap,
  {S.two_class('token', S.AR_NARROW, 'a-zA-Z', 'other')} AS script, count(*)::BIGINT AS types, sum(total_count)::BIGINT AS occurrences, count(*) FILTER (total_count = 1)::BIGINT AS hapaxes, round(avg((total_count <= 5)::INT), 6) AS rare_share FROM u GROUP BY ALL"""
)
def vocab_hapax_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Types and occurrences by overlap of the sources and script, with hapaxes."""
    y, j = F.col("youtube_count") > 0, F.col("djelfa_count") > 0
    u = unigrams(spark, d).select(F.when(y & j, "shared").when(y, "youtube_only").otherwise("djelfa_only").alias("overlap"), T.script_narrow(F.col("token")).alias("script"), "total_count")
    return u.groupBy("overlap", "script").agg(
        F.count(F.lit(1)).alias("types"), F.sum("total_count").alias("occurrences"), F.count_if(F.col("total_count") == 1).alias("hapaxes"), F.round(F.avg((F.col("total_count") <= 5).cast("int")), 6).alias("rare_share")
    )


@query(
    f"SELECT token, n FROM (SELECT token, count(*)::BIGINT AS n, min(doc_id * 1000000 + pos) AS first_seen FROM (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {S.vocabulary('text')} AS w FROM documents)) GROUP BY token) ORDER BY n DESC, first_seen LIMIT 25"
)
def top_tokens_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The 25 most frequent terms, ties by first occurrence (a top-k report)."""
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(T.vocabulary_tokens(F.col("text"))).alias("pos", "token"))
    g = x.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("doc_id") * 1000000 + F.col("pos") + 1).alias("first_seen"))
    return g.orderBy(F.desc("n"), "first_seen").limit(25).select("token", "n")


_GRAMS = f"(SELECT ['<s>', '<s>'] || {S.vocabulary('text')} || ['</s>'] AS w FROM documents WHERE text IS NOT NULL)"
_TRI = f"SELECT w1, w2, w3, count(*)::BIGINT AS n FROM (SELECT w[i - 2] AS w1, w[i - 1] AS w2, w[i] AS w3 FROM (SELECT w, unnest(range(3, len(w) + 1)) AS i FROM {_GRAMS})) GROUP BY ALL"


@query(_TRI)
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    """Trigram counts with sentence padding; bigrams and unigrams are sums of them."""
    return ngram.trigrams(spark.read.parquet(f"{d}/documents.parquet"), T.vocabulary_tokens(F.col("text")))


@query(
    f"""WITH t AS ({_TRI}), p AS (SELECT * FROM (VALUES (1, '<s>', '<s>'), (2, 'نسكن', 'في'), (3, 'la', 'belle'), (4, 'zzzz', 'la'), (5, 'zzzz', 'qqqq')) v(prefix_id, w1, w2)),
three AS (SELECT prefix_id, w3 AS token, n FROM p JOIN t USING (w1, w2)),
two AS (SELECT prefix_id, w3 AS token, sum(n) AS n FROM p JOIN t ON p.w2 = t.w2 WHERE prefix_id NOT IN (SELECT prefix_id FROM three) GROUP BY ALL),
one AS (SELECT prefix_id, token, n FROM p, (SELECT w3 AS token, sum(n) AS n FROM t WHERE w3 <> '</s>' GROUP BY w3) WHERE prefix_id NOT IN (SELECT prefix_id FROM three) AND prefix_id NOT IN (SELECT prefix_id FROM two)),
u AS (SELECT * FROM three UNION ALL SELECT * FROM two UNION ALL SELECT * FROM one)
SELECT prefix_id, token, n::BIGINT AS n, round(pow(n, 1 / 0.8) / sum(pow(n, 1 / 0.8)) OVER (PARTITION BY prefix_id), 9) AS p FROM u"""
)
def next_token_dist(spark: SparkSession, d: str) -> DataFrame:
    """Next-token distribution of prefixes: trigram if its context was seen, else bigram, else unigram; temperature 0.8."""
    prefixes = spark.createDataFrame([(1, "<s>", "<s>"), (2, "نسكن", "في"), (3, "la", "belle"), (4, "zzzz", "la"), (5, "zzzz", "qqqq")], "prefix_id int, w1 string, w2 string")
    return ngram.next_tokens(ngram_counts(spark, d), prefixes, temperature=0.8)


@query(
    f"""WITH RECURSIVE t AS ({_TRI}), two AS (SELECT w2, w3, sum(n) AS n FROM t GROUP BY ALL), one AS (SELECT w3, sum(n) AS n FROM t WHERE w3 <> '</s>' GROUP BY w3),
b3 AS (SELECT w1, w2, arg_max(w3, ROW(n, w3)) AS x3 FROM t GROUP BY w1, w2), b2 AS (SELECT w2, arg_max(w3, ROW(n, w3)) AS x2 FROM two GROUP BY w2), b1 AS (SELECT arg_max(w3, ROW(n, w3)) AS x1 FROM one),
r AS (SELECT prefix_id, 0 AS step, w1, w2, '' AS token FROM (VALUES (1, '<s>', '<s>'), (2, 'la', 'belle'), (3, 'had', 'lbab')) p(prefix_id, w1, w2) UNION ALL
  SELECT r.prefix_id, r.step + 1, r.w2, coalesce(x3, x2, x1), coalesce(x3, x2, x1) FROM r LEFT JOIN b3 USING (w1, w2) LEFT JOIN b2 ON b2.w2 = r.w2, b1 WHERE r.step < 8 AND r.token <> '</s>')
SELECT prefix_id, step::INT AS step, token FROM r WHERE step > 0"""
)
def backoff_complete_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Greedy completion of prefixes up to eight tokens."""
    prefixes = spark.createDataFrame([(1, "<s>", "<s>"), (2, "la", "belle"), (3, "had", "lbab")], "prefix_id int, w1 string, w2 string")
    return ngram.complete(ngram_counts(spark, d), prefixes, 8)


def _discounts(t: str) -> str:
    """Discounts d1, d2, d3 of a table of counts, the usual fallbacks for small or odd ones."""
    d = {1: "1 - 2 * y * n2 / n1", 2: "2 - 3 * y * n3 / n2", 3: "3 - 4 * y * n4 / n3"}
    each = ", ".join(f"CASE WHEN n1 = 0 OR n2 = 0 OR n3 = 0 OR {e} <= 0 THEN {k / 2} ELSE {e} END AS d{k}" for k, e in d.items())
    return f"SELECT {each} FROM (SELECT *, n1 / (n1 + 2.0 * n2)::DOUBLE AS y FROM (SELECT {', '.join(f'count(*) FILTER (n = {k})::DOUBLE AS n{k}' for k in range(1, 5))} FROM {t}))"


_CUT = "CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"
_KN = f"""WITH x AS (SELECT * FROM (SELECT doc_id, batch_no, {profile._DOC_SCRIPT.replace(' w,', ' ww,').replace('(w,', '(ww,')} AS bucket, w FROM (SELECT doc_id, batch_no, {S.words('text')} AS ww, {S.vocabulary('text')} AS w FROM documents WHERE text IS NOT NULL)) WHERE bucket IS NOT NULL),
g AS (SELECT doc_id, batch_no, w[i - 2] AS w1, w[i - 1] AS w2, w[i] AS w3 FROM (SELECT doc_id, batch_no, w, unnest(range(3, len(w) + 1)) AS i FROM (SELECT doc_id, batch_no, ['<s>', '<s>'] || w || ['</s>'] AS w FROM x))),
tri AS (SELECT w1, w2, w3, count(*) AS n FROM g WHERE batch_no = 0 GROUP BY ALL),
bi AS (SELECT w2, w3, CASE WHEN w2 = '<s>' THEN sum(n) ELSE count(*) END AS n FROM tri GROUP BY w2, w3),
uni AS (SELECT w3, count(*) AS n FROM bi GROUP BY w3),
e3 AS ({_discounts('tri')}), e2 AS ({_discounts('bi')}), e1 AS ({_discounts('uni')}),
t1 AS (SELECT sum(n)::DOUBLE AS total, sum({_CUT}) AS gone, count(*) + 1 AS types FROM uni, e1),
p0 AS (SELECT gone / total / types AS p0 FROM t1),
p1 AS (SELECT w3, (n - {_CUT}) / total + p0 AS p1 FROM uni, e1, t1, p0),
c2 AS (SELECT w2, sum(n)::DOUBLE AS total, sum({_CUT}) AS gone FROM bi, e2 GROUP BY w2),
p2 AS (SELECT bi.w2, bi.w3, (n - {_CUT}) / total + gone / total * p1 AS p2 FROM bi JOIN c2 USING (w2) JOIN p1 USING (w3), e2),
c3 AS (SELECT w1, w2, sum(n)::DOUBLE AS total, sum({_CUT}) AS gone FROM tri, e3 GROUP BY w1, w2),
p3 AS (SELECT tri.w1, tri.w2, tri.w3, (n - {_CUT}) / total + gone / total * p2 AS p3 FROM tri JOIN c3 USING (w1, w2) JOIN p2 USING (w2, w3), e3),
s AS (SELECT g.doc_id, sum(log10(coalesce(p3, coalesce(c3.gone / c3.total, 1) * coalesce(p2, coalesce(c2.gone / c2.total, 1) * coalesce(p1, p0))))) AS lp, count(*) FILTER (p1 IS NULL) AS oov, count(*) AS tokens
  FROM g LEFT JOIN p3 USING (w1, w2, w3) LEFT JOIN p2 ON p2.w2 = g.w2 AND p2.w3 = g.w3 LEFT JOIN p1 ON p1.w3 = g.w3 LEFT JOIN c3 ON c3.w1 = g.w1 AND c3.w2 = g.w2 LEFT JOIN c2 ON c2.w2 = g.w2, p0 WHERE batch_no > 0 GROUP BY g.doc_id)
SELECT bucket, count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS words, round(pow(10.0, -sum(lp) / nullif(sum(len(w)), 0)), 4) AS perplexity_per_word, round(sum(oov) / sum(tokens), 6) AS oov_token_rate FROM x JOIN s USING (doc_id) GROUP BY bucket"""


@query(_KN)
def kn_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Modified Kneser-Ney trigram model of the history, scored on the new batches, by script bucket."""
    x = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null").select("doc_id", "batch_no", T.document_script(F.col("text")).alias("bucket"), T.vocabulary_tokens(F.col("text")).alias("w")).filter("bucket is not null")
    model = ngram.kneser_ney(x.filter("batch_no = 0"), "w")
    return ngram.perplexity(model, x.filter("batch_no > 0"), "doc_id", "w", "bucket")


QUERIES, ORACLES = query.queries, query.oracles
