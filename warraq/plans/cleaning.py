"""Cleaning rules, processed records, near-duplicates, transliteration, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, html, translit
from ..functions import text as T
from ..operators import neardup
from ..operators.common import spread
from ..operators.registry import Registry
from . import sqltext as S

query = Registry()


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_CLOCK = r"'(^|[^\p{L}\p{N}_])\p{Nd}{1,2}:\p{Nd}{2}(:\p{Nd}{2})?([^\p{L}\p{N}_]|$)', '\1 \3', 'g'"


# RE2 has no look-ahead, so a match takes the character after it; the second pass finds times that adjoin.
@query(f"SELECT row_id, regexp_replace(regexp_replace({S.clean_light('text')}, {_CLOCK}), {_CLOCK}) AS text FROM youtube_comments WHERE text IS NOT NULL")
def clean_mentions_urls(spark: SparkSession, d: str) -> DataFrame:
    """Marks, mentions, links and clock times."""
    c = T.strip_clock_times(T.replace_urls(T.replace_mentions(T.strip_tachkil(F.col("text")))))
    return _t(spark, d, "youtube_comments").filter("text is not null").select("row_id", c.alias("text"))


_CH = "string_split(text, '')"


@query(
    rf"SELECT row_id, array_to_string(list_filter(c, lambda x, i: NOT (i > 2 AND x = c[i - 1] AND x = c[i - 2] AND regexp_full_match(x, '[\p{{L}}\p{{Nl}}\p{{No}}]'))), '') AS text FROM (SELECT row_id, {_CH} AS c FROM youtube_comments WHERE text <> '')"
)
def collapse_elongation(spark: SparkSession, d: str) -> DataFrame:
    """Stretched letters."""
    return _t(spark, d, "youtube_comments").filter("text <> ''").select("row_id", T.collapse_elongation(F.col("text")).alias("text"))


@query(
    r"SELECT row_id, array_to_string(list_filter(c, lambda x, i: NOT (i > 2 AND x = c[i - 1] AND x = c[i - 2] AND x IN ('!', '?', '؟', ',', '،'))), '') AS text FROM (SELECT row_id, string_split(regexp_replace(text, '\.{2,}', '...', 'g'), '') AS c FROM forum_posts WHERE text <> '')"
)
def punctuation_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of dots and of other punctuation."""
    return _t(spark, d, "forum_posts").filter("text <> ''").select("row_id", T.collapse_punctuation(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {S.blanks('text')} AS text FROM documents WHERE text IS NOT NULL")
def whitespace_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Blank runs, newlines, strip."""
    return _t(spark, d, "documents").filter("text is not null").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query(r"SELECT row_id, regexp_replace(regexp_replace(text, '[\x{64b}-\x{65f}\x{670}]', '', 'g'), '\x{640}+', '', 'g') AS text FROM forum_posts WHERE text IS NOT NULL")
def strip_marks(spark: SparkSession, d: str) -> DataFrame:
    """Diacritics and tatweel."""
    return _t(spark, d, "forum_posts").filter("text is not null").select("row_id", T.strip_tatweel(T.strip_tachkil(F.col("text"))).alias("text"))


@query(
    rf"SELECT row_id, replace(regexp_replace(replace(regexp_replace(regexp_replace(text, '(?s)أكبر تواجد بالمنتدى كان.*', ''), 'اقتباس:{S.WS}*\nالمشاركة الأصلية كتبت بواسطة{S.WS}+[^\t-\r\x{{1c}}-\x{{20}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'), '[URL]', chr(57345)), '\[/?[a-zA-Z]+(=[^\]]*)?{S.WS}*\]', ' ', 'g'), chr(57345), '[URL]') AS text FROM forum_posts WHERE text IS NOT NULL"
)
def bbcode_quote_widget(spark: SparkSession, d: str) -> DataFrame:
    """Widget blocks, quote headers and BBCode."""
    c = T.strip_bbcode(T.strip_quote_header(T.strip_widget(F.col("text"))))
    return _t(spark, d, "forum_posts").filter("text is not null").select("row_id", c.alias("text"))


@query(rf"SELECT source_type, count(*)::BIGINT AS kept FROM youtube_comments WHERE length({S.strip(rf'''regexp_replace(regexp_replace(text, '[{S.EMOJI}]', '', 'g'), '[^\p{{L}}\p{{N}}_\x{{600}}-\x{{6ff}}]', '', 'g')''')}) >= 2 GROUP BY source_type")
def near_empty_filter(spark: SparkSession, d: str) -> DataFrame:
    """Comments with at least two residual letters."""
    return _t(spark, d, "youtube_comments").filter(T.residual_letters(F.col("text")) >= 2).groupBy("source_type").agg(F.count(F.lit(1)).alias("kept"))


@query()
def clean_comments(spark: SparkSession, d: str) -> DataFrame:
    """Processed comments: cleaned, near-empty dropped, flat record."""
    x = spread(_t(spark, d, "youtube_comments")).withColumn("text", clean.cleaned(F.col("text"))).filter("text is not null")
    return x.select(
        F.concat(F.lit("yt_"), "video_id", F.lit("_"), "comment_id").alias("id"),
        "text",
        F.lit("youtube").alias("source"),
        "source_type",
        "video_id",
        "channel",
        "scrape_date",
        F.lit(None).cast("string").alias("script"),
        F.lit(None).cast("double").alias("darija_confidence"),
        F.length("text").alias("char_count"),
        T.word_count(F.col("text")).alias("token_count"),
    )


@query()
def clean_posts(spark: SparkSession, d: str) -> DataFrame:
    """Processed posts: cleaned, near-empty dropped, nested source metadata."""
    x = spread(_t(spark, d, "forum_posts")).withColumn("text", clean.cleaned(F.col("text"), post=True)).filter("text is not null")
    meta = F.struct(F.col("subforum_id").alias("subforum"), "thread_title", "thread_url", "post_url", "author")
    return x.select(
        F.concat(F.lit("djelfa_"), "post_id").alias("id"), "text", F.lit("djelfa_info").alias("source"), F.lit("forum_post").alias("source_type"), meta.alias("source_metadata"), "scrape_date",
        F.to_timestamp("post_time", "yyyy-MM-dd, HH:mm").alias("posted_at"), F.length("text").alias("char_count"), T.word_count(F.col("text")).alias("token_count"),
    )


@query()
def emoji_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Emoji runs and joiners (needs back-references and look-ahead)."""
    x = _t(spark, d, "youtube_comments").filter(F.col("text").rlike(f"[{T.EMOJI}]"))
    return x.select("row_id", T.collapse_emoji(T.strip_invisible(F.col("text"))).alias("text"))


@query()
def nfkc_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Texts that NFKC changes."""
    x = _t(spark, d, "documents").filter("text is not null").select("doc_id", "text", clean.nfkc(F.col("text")).alias("normal"))
    return x.filter("text <> normal").select("doc_id", "normal")


@query()
def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    """Signature digests of all documents."""
    return _t(spark, d, "documents").select("doc_id", neardup.digest(neardup.signature(F.col("text"))).alias("dedup_hash"))


@query()
def near_dup_keep(spark: SparkSession, d: str) -> DataFrame:
    """Greedy MinHash-LSH decisions over all documents."""
    return neardup.keep_first(_t(spark, d, "documents"), "doc_id", "text")


@query()
def transliterate_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Likeliest Latin rendering of the posts in Arabic script."""
    x = _t(spark, d, "forum_posts").filter(F.col("text").rlike(f"[{T.ARABIC_NARROW}]"))
    return x.select("row_id", translit.transliterate(F.col("text")).alias("latin"))


@query()
def augment_balance(spark: SparkSession, d: str) -> DataFrame:
    """Script-balanced corpus: originals, and drawn renderings of a fifth of the Arabic (by channel) and all mixed documents."""
    from ..operators.sampling import stratified_fraction

    x = _t(spark, d, "documents").select("doc_id", "text", F.coalesce("channel", F.lit("_unknown")).alias("channel"), T.document_script(F.col("text")).alias("script_bucket")).filter("script_bucket is not null")
    chosen = stratified_fraction(x.filter("script_bucket = 'arabic'"), "doc_id", "channel", 0.2, 42).unionByName(x.filter("script_bucket = 'mixed'").select("doc_id"))
    # Only chosen documents reach the Python stage.
    picked = x.join(chosen, "doc_id", "left_semi")
    made = picked.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_translit")).alias("id"), translit.transliterate(F.col("text"), F.col("doc_id"), 7).alias("text"), "channel", "script_bucket",
        F.lit(True).alias("is_transliterated"), F.col("doc_id").cast("string").alias("source_id"),
    )
    own = x.select(F.col("doc_id").cast("string").alias("id"), "text", "channel", "script_bucket", F.lit(False).alias("is_transliterated"))
    return own.unionByName(made, allowMissingColumns=True)


_PAGE = (
    '<html><td class="tcat"><a href="forumdisplay.php?f=7">Cat</a></td><tbody id="collapseobj_forumbit_7"><a href="forumdisplay.php?f=19"><b>Sub</b></a></tbody>'
    '<a id="thread_title_t1"><b>Thread One</b></a><div class="pagenav"><a rel="next" href="?page=2">></a></div>'
    '<table id="post1"><td class="thead">2020-01-01, 00:00</td><a class="bigusername">u</a><div id="post_message_1">hello<br>there</div></table></html>'
)


@query()
def html_posts(spark: SparkSession, d: str) -> DataFrame:
    """Post records of a page, with the page predicates."""
    pages = spark.createDataFrame([(1, _PAGE), (2, "<html><title>Just a moment...</title>"), (3, None)], "page_id int, html string")
    return pages.select("page_id", html.permission_denied(F.col("html")).alias("denied"), html.is_challenge(F.col("html")).alias("challenge"), F.expr("html")).select(
        "page_id", "denied", "challenge", F.inline_outer(html.posts_column(F.col("html")))
    )


QUERIES, ORACLES = query.queries, query.oracles
