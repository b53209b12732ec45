"""Corpus profile: totals, scripts, lengths, prevalence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.common import spread
from . import sqltext as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its oracle if SQL can say it."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def docs(spark: SparkSession, d: str) -> DataFrame:
    """The documents table."""
    return spark.read.parquet(f"{d}/documents.parquet")


LONG = "bigint"


@query(
    f"""SELECT coalesce(lang, 'ALL') AS lang, docs, tokens, round(tokens / docs, 6) AS mean_tokens, arabic, latin, mixed, digits_symbols FROM (
  SELECT lang, count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS tokens,
    sum(len(list_filter(w, lambda x: {S.token_class('x')} = 'arabic')))::BIGINT AS arabic, sum(len(list_filter(w, lambda x: {S.token_class('x')} = 'latin')))::BIGINT AS latin,
    sum(len(list_filter(w, lambda x: {S.token_class('x')} = 'mixed')))::BIGINT AS mixed, sum(len(list_filter(w, lambda x: {S.token_class('x')} = 'digits_symbols')))::BIGINT AS digits_symbols
  FROM (SELECT coalesce(lang, '_none') AS lang, {S.words('t')} AS w FROM (SELECT lang, {S.blanks(S.clean_light('text'))} AS t FROM documents) WHERE length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) >= 2)
  GROUP BY ROLLUP (lang))"""
)
def clean_profile(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: lightly cleaned documents by language with a total row: tokens and their script classes."""
    t = T.normalize_whitespace(T.replace_urls(T.replace_mentions(T.strip_tachkil(F.col("text")))))
    kept = spread(docs(spark, d).select(F.coalesce("lang", F.lit("_none")).alias("lang"), "text")).select("lang", t.alias("t"))
    tokens = kept.filter(F.length(F.regexp_replace("t", r"[^\p{L}]", "")) >= 2).select("lang", F.posexplode_outer(T.words(F.col("t"))))
    kinds = ("arabic", "latin", "mixed", "digits_symbols")
    # One classification a token, combined by language first; the total row is rolled up from those few rows.
    by = tokens.select("lang", "pos", T.token_class(F.col("col")).alias("k"), F.col("col").isNotNull().alias("is_token")).groupBy("lang").agg(
        F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("docs"), F.count_if("is_token").alias("tokens"), *[F.count_if(F.col("is_token") & (F.col("k") == k)).alias(k) for k in kinds]
    )
    g = by.rollup("lang").agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", *kinds)])
    return g.select(F.coalesce("lang", F.lit("ALL")).alias("lang"), "docs", "tokens", F.round(F.col("tokens") / F.col("docs"), 6).alias("mean_tokens"), *kinds)


@query(
    f"SELECT count(*)::BIGINT AS docs, coalesce(sum(len({S.words('text')})), 0)::BIGINT AS tokens, coalesce(sum(length(text)), 0)::BIGINT AS chars, count(DISTINCT channel)::BIGINT AS channels, count(DISTINCT source)::BIGINT AS sources FROM documents"
)
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens, characters, distinct channels and sources."""
    return docs(spark, d).agg(
        F.count(F.lit(1)).alias("docs"),
        F.coalesce(F.sum(T.word_count(F.col("text"))), F.lit(0)).cast(LONG).alias("tokens"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast(LONG).alias("chars"),
        F.countDistinct("channel").alias("channels"),
        F.countDistinct("source").alias("sources"),
    )


@query(
    f"SELECT source, class, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM (SELECT source, {S.token_class('tok')} AS class FROM (SELECT source, unnest({S.words('text')}) AS tok FROM documents)) GROUP BY source, class"
)
def token_script_counts(spark: SparkSession, d: str) -> DataFrame:
    """Token classes by source with their share."""
    tokens = spread(docs(spark, d).select("source", "text")).select("source", F.explode(T.words(F.col("text"))).alias("t"))
    counts = tokens.groupBy("source", T.token_class(F.col("t")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source", "class", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6).alias("share"))


@query(f"SELECT {S.two_class('text', S.AR_NARROW, 'a-zA-Z', 'other')} AS script, count(*)::BIGINT AS n FROM forum_posts WHERE text IS NOT NULL GROUP BY 1")
def script_classify_narrow(spark: SparkSession, d: str) -> DataFrame:
    """Posts by narrow script class."""
    p = spark.read.parquet(f"{d}/forum_posts.parquet").filter("text is not null")
    return p.groupBy(T.script_narrow(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


_RATIO = f"len(regexp_extract_all(text, '[{S.AR_MID}]'))", "len(regexp_extract_all(text, '[a-zA-Z]'))"
_BUCKET = f"CASE WHEN text IS NULL THEN 'null_text' WHEN {_RATIO[0]} + {_RATIO[1]} = 0 THEN 'no_letters' WHEN {_RATIO[0]} / ({_RATIO[0]} + {_RATIO[1]}) >= 0.85 THEN 'arabic' WHEN {_RATIO[0]} / ({_RATIO[0]} + {_RATIO[1]}) <= 0.15 THEN 'latin' ELSE 'mixed' END"


@query(
    f"SELECT source, count(*) FILTER (b = 'arabic')::BIGINT AS arabic, count(*) FILTER (b = 'latin')::BIGINT AS latin, count(*) FILTER (b = 'mixed')::BIGINT AS mixed, count(*) FILTER (b = 'no_letters')::BIGINT AS no_letters, round(count(*) FILTER (b = 'arabic') / count(*), 3) AS arabic_share FROM (SELECT source, {_BUCKET} AS b FROM documents) GROUP BY source"
)
def text_script_ratio_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Source by script-ratio bucket as a pivot, with the Arabic share of rows."""
    b = spread(docs(spark, d).select("source", "text")).select("source", F.coalesce(T.script_ratio_bucket(F.col("text")), F.lit("null_text")).alias("b"))
    names = ["arabic", "latin", "mixed", "no_letters"]
    # Conditional counts in one aggregate: a pivot with known values.
    return b.groupBy("source").agg(*[F.count_if(F.col("b") == n).alias(n) for n in names], F.round(F.count_if(F.col("b") == "arabic") / F.count(F.lit(1)), 3).alias("arabic_share"))


_CLS = {k: f"len(list_filter(w, lambda x: {S.token_class('x')} = '{k}'))" for k in ("arabic", "latin", "mixed", "digits_symbols")}
_DOC_SCRIPT = f"CASE WHEN {_CLS['mixed']} > 0 OR ({_CLS['arabic']} > 0 AND {_CLS['latin']} > 0) THEN 'mixed' WHEN {_CLS['arabic']} > 0 THEN 'arabic' WHEN {_CLS['latin']} > 0 THEN 'latin' END"


@query(f"SELECT b AS script_bucket, count(*)::BIGINT AS n FROM (SELECT {_DOC_SCRIPT} AS b FROM (SELECT {S.words('text')} AS w FROM youtube_comments)) WHERE b IS NOT NULL GROUP BY b")
def doc_script_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Comments by script of their tokens; those without letters dropped."""
    c = spark.read.parquet(f"{d}/youtube_comments.parquet")
    return c.select(T.document_script(F.col("text")).alias("script_bucket")).filter("script_bucket is not null").groupBy("script_bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT dominance, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM (
  SELECT CASE WHEN w IS NULL OR len(w) = 0 THEN 'Empty' WHEN {_CLS['arabic']} / len(w) >= 0.7 THEN 'Arabic' WHEN {_CLS['latin']} / len(w) >= 0.7 THEN 'Latin'
    WHEN {_CLS['arabic']} + {_CLS['latin']} + {_CLS['mixed']} > 0 THEN 'Code-Switched' ELSE 'Symbols' END AS dominance FROM (SELECT {S.words('text')} AS w FROM documents)) GROUP BY dominance"""
)
def doc_dominance(spark: SparkSession, d: str) -> DataFrame:
    """Documents by dominant script, with percent."""
    g = docs(spark, d).groupBy(T.document_dominance(F.col("text")).alias("dominance")).agg(F.count(F.lit(1)).alias("n"))
    # A window over five groups.
    return g.select("dominance", "n", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("percent"))


@query(
    f"SELECT lang, count(*) FILTER (s = 'arabic')::BIGINT AS arabic, count(*) FILTER (s = 'latin')::BIGINT AS latin, count(*) FILTER (s = 'mixed')::BIGINT AS mixed, count(*) FILTER (s = 'other_empty')::BIGINT AS other_empty FROM (SELECT lang, {S.two_class('text', S.AR_TWEET, S.LA_WIDE, 'other_empty')} AS s FROM documents WHERE text IS NOT NULL) GROUP BY lang"
)
def script_by_lang_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Language by script as a crosstab over fixed values."""
    x = docs(spark, d).filter("text is not null").select("lang", T.script_tweet(F.col("text")).alias("s"))
    return x.groupBy("lang").agg(*[F.count_if(F.col("s") == n).alias(n) for n in ("arabic", "latin", "mixed", "other_empty")])


@query(
    """SELECT source, count(n_chars)::BIGINT AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min, max(n_chars) AS max,
  quantile_cont(n_chars, 0.25)::DOUBLE AS q25, quantile_cont(n_chars, 0.5)::DOUBLE AS q50, quantile_cont(n_chars, 0.75)::DOUBLE AS q75, quantile_cont(n_chars, 0.9)::DOUBLE AS q90, quantile_cont(n_chars, 0.95)::DOUBLE AS q95, quantile_cont(n_chars, 0.99)::DOUBLE AS q99 FROM documents GROUP BY source"""
)
def doc_length_summary(spark: SparkSession, d: str) -> DataFrame:
    """Exact length summary by source (linear interpolation)."""
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}
    return (
        docs(spark, d)
        .groupBy("source")
        .agg(
            F.count("n_chars").alias("n"),
            F.round(F.avg("n_chars"), 6).alias("mean"),
            F.round(F.stddev_samp("n_chars"), 6).alias("std"),
            F.min("n_chars").alias("min"),
            F.max("n_chars").alias("max"),
            F.percentile("n_chars", F.array(*[F.lit(p) for p in probs.values()])).alias("q"),
        )
        .select("source", "n", "mean", "std", "min", "max", *[F.element_at("q", k + 1).alias(name) for k, name in enumerate(probs)])
    )


@query(
    "SELECT source, n_chars AS upper_median FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars IS NOT NULL) WHERE r = n // 2 + 1"
)
def upper_median_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The upper median (element n div 2 of the sorted values) over counts by value, so that no source's rows are gathered."""
    counts = docs(spark, d).filter("n_chars is not null").groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("source").orderBy("n_chars")
    upto = counts.select("source", "n_chars", "c", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("u"), F.sum("c").over(Window.partitionBy("source")).alias("n"))
    rank = F.floor(F.col("n") / 2) + 1
    return upto.filter((F.col("u") >= rank) & (F.col("u") - F.col("c") < rank)).select("source", F.col("n_chars").alias("upper_median"))


# Patterns whose prevalence is measured.
_PREV = {
    "url": (T.URL, r"(?i)(?:https?://\S+|www\.\S+)"),
    "mention": (T.MENTION, r"@[\p{L}\p{N}_.]+"),
    "clock": (r"(^|[^\p{L}\p{N}_])\p{Nd}{1,2}:\p{Nd}{2}", r"(^|[^\p{L}\p{N}_])\p{Nd}{1,2}:\p{Nd}{2}"),
    "invisible": (T.INVISIBLE, r"[\x{200b}\x{200c}\x{200e}\x{200f}\x{2066}-\x{2069}\x{feff}]"),
    "tachkil": (T.TACHKIL, r"[\x{64b}-\x{65f}\x{670}]"),
    "tatweel": (T.TATWEEL, r"\x{640}+"),
    "dots": (r"\.{2,}", r"\.{2,}"),
    "bbcode": (r"\[/?[a-zA-Z]+(?:=[^\]]*)?\]", r"\[/?[a-zA-Z]+(?:=[^\]]*)?\]"),
    "glued": (r"@[\p{L}\p{N}_.]++(?=[^\s\p{Z}])", None),
    "elongation": (rf"({T.LETTER})\1{{2,}}", None),
}


@query(
    "SELECT count(*)::BIGINT AS n, "
    + ", ".join(f"round(100.0 * count(*) FILTER (regexp_matches(text, '{p}')) / count(*), 4) AS {k}" for k, (_, p) in _PREV.items() if p)
    + " FROM youtube_comments WHERE text IS NOT NULL"
)
def pattern_prevalence(spark: SparkSession, d: str) -> DataFrame:
    """Percent of comments with each pattern, in one pass."""
    c = spark.read.parquet(f"{d}/youtube_comments.parquet").filter("text is not null")
    n = F.count(F.lit(1))
    return c.agg(n.alias("n"), *[F.round(F.lit(100.0) * F.count_if(F.col("text").rlike(p)) / n, 4).alias(k) for k, (p, sql) in _PREV.items() if sql])


@query()
def pattern_prevalence_lookaround(spark: SparkSession, d: str) -> DataFrame:
    """Patterns that need look-around or back-references: mentions glued to text, stretched letters."""
    c = spark.read.parquet(f"{d}/youtube_comments.parquet").filter("text is not null")
    n = F.count(F.lit(1))
    return c.agg(n.alias("n"), *[F.round(F.lit(100.0) * F.count_if(F.col("text").rlike(p)) / n, 4).alias(k) for k, (p, sql) in _PREV.items() if not sql])


# Spellings looked for as substrings.
LEXICON = ("bezaf", "walou", "chkoun", "kifach", "wach", "بزاف", "واش", "شكون", "كيفاش", "مكاش")


@query(
    "SELECT source, count(*)::BIGINT AS docs, sum(h)::BIGINT AS hits, round(avg((h = 0)::INT), 6) AS without FROM (SELECT source, "
    + " + ".join(f"contains(lower(text), '{v}')::INT" for v in LEXICON)
    + " AS h FROM documents WHERE text IS NOT NULL) GROUP BY source"
)
def lexicon_hits(spark: SparkSession, d: str) -> DataFrame:
    """Variants contained in each document, and the share of documents without any."""
    low = F.lower("text")
    hits = sum((low.contains(v).cast("int") for v in LEXICON[1:]), low.contains(LEXICON[0]).cast("int"))
    x = docs(spark, d).filter("text is not null").select("source", hits.alias("h"))
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("h").cast(LONG).alias("hits"), F.round(F.avg((F.col("h") == 0).cast("int")), 6).alias("without"))


@query(f"SELECT least(len({S.words('text')}), 30)::BIGINT AS tokens, count(*)::BIGINT AS n FROM youtube_comments WHERE text IS NOT NULL GROUP BY 1")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of token counts, clipped at 30."""
    c = spark.read.parquet(f"{d}/youtube_comments.parquet").filter("text is not null")
    return c.groupBy(F.least(T.word_count(F.col("text")), F.lit(30)).cast(LONG).alias("tokens")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT n AS emoji, count(*)::BIGINT AS comments FROM (SELECT len(regexp_extract_all(text, '[{S.EMOJI}]'))::BIGINT AS n FROM youtube_comments WHERE text IS NOT NULL) GROUP BY n")
def emoji_counts(spark: SparkSession, d: str) -> DataFrame:
    """Comments by number of emoji."""
    c = spark.read.parquet(f"{d}/youtube_comments.parquet").filter("text is not null")
    return c.groupBy(F.regexp_count("text", F.lit(f"[{T.EMOJI}]")).cast(LONG).alias("emoji")).agg(F.count(F.lit(1)).alias("comments"))


_NOISE = r"regexp_replace(regexp_replace(text, 'https?://[^\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '@[\p{L}\p{N}_]+', ' ', 'g')"


@query(
    f"SELECT raw, stripped, count(*)::BIGINT AS n FROM (SELECT {S.two_class('text', S.AR_TWEET, S.LA_WIDE, 'other_empty')} AS raw, {S.two_class(S.strip(_NOISE), S.AR_TWEET, S.LA_WIDE, 'other_empty')} AS stripped FROM documents WHERE source = 'tweets_dz' AND text IS NOT NULL) GROUP BY raw, stripped"
)
def tweet_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Script of short posts before and after links and mentions are removed."""
    bare = T.strip(F.regexp_replace(F.regexp_replace("text", rf"https?://{T.NON_WS}+", " "), r"@[\p{L}\p{N}_]+", " "))
    x = docs(spark, d).filter((F.col("source") == "tweets_dz") & F.col("text").isNotNull())
    return x.groupBy(T.script_tweet(F.col("text")).alias("raw"), T.script_tweet(bare).alias("stripped")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"SELECT count(*) FILTER (regexp_matches(text, '[{S.AR_NARROW}]') AND NOT regexp_matches(text, '[a-zA-Z]'))::BIGINT AS arabic_only, count(*) FILTER (regexp_matches(text, '[a-zA-Z]') AND len(regexp_extract_all(text, '[{S.AR_NARROW}]')) < 3)::BIGINT AS latin_mostly FROM youtube_comments"
)
def script_filters(spark: SparkSession, d: str) -> DataFrame:
    """Texts only in Arabic script, and texts mostly in Latin script."""
    c, ar, la = F.col("text"), F.col("text").rlike(f"[{T.ARABIC_NARROW}]"), F.col("text").rlike(f"[{T.LATIN}]")
    return spark.read.parquet(f"{d}/youtube_comments.parquet").agg(
        F.count_if(ar & ~la).alias("arabic_only"), F.count_if(la & (F.regexp_count(c, F.lit(f"[{T.ARABIC_NARROW}]")) < 3)).alias("latin_mostly")
    )


@query("SELECT doc_id, replace(substring(text, 1, 60), chr(10), ' ') AS preview FROM documents WHERE text IS NOT NULL")
def text_preview(spark: SparkSession, d: str) -> DataFrame:
    """First 60 code points with newlines as blanks."""
    return docs(spark, d).filter("text is not null").select("doc_id", F.translate(F.substring("text", 1, 60), "\n", " ").alias("preview"))
