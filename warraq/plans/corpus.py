"""Corpus building and its checks: ranked vocabulary, pages, projections, label joins, lookups, tokenizers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..functions import text as T
from ..operators import embeddings, ordering, tokenizers
from ..operators.registry import Registry
from . import sqltext as S
from . import vocabulary

query = Registry()


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- order ------------------------------------------------------------------


@query(f"SELECT *, row_number() OVER (ORDER BY total_count DESC, token) AS rank FROM ({vocabulary.ORACLES['vocab_unigrams']})")
def vocab_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The whole vocabulary by frequency, with its ranks; ties by term."""
    return ordering.positioned(vocabulary.unigrams(spark, d), [F.desc("total_count"), F.asc("token")], "rank")


@query("SELECT position, doc_id, row_id FROM (SELECT row_number() OVER (ORDER BY doc_id) AS position, doc_id FROM documents) JOIN (SELECT row_number() OVER (ORDER BY row_id) AS position, row_id FROM forum_posts) USING (position)")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Documents and posts side by side, by their place in order."""
    return ordering.zipped(_t(spark, d, "documents").select("doc_id"), [F.asc("doc_id")], _t(spark, d, "forum_posts").select("row_id"), [F.asc("row_id")])


@query("SELECT source, id FROM (SELECT 'documents' AS source, doc_id AS id FROM documents UNION ALL SELECT 'forum_posts', row_id FROM forum_posts) ORDER BY source, id LIMIT 1000")
def limit_across_sources(spark: SparkSession, d: str) -> DataFrame:
    """The first thousand rows over several sources (a limit is the feature)."""
    a = _t(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"))
    b = _t(spark, d, "forum_posts").select(F.lit("forum_posts").alias("source"), F.col("row_id").alias("id"))
    return a.unionByName(b).orderBy("source", "id").limit(1000)


@query("SELECT doc_id, left(text, 80) AS preview FROM documents WHERE text IS NOT NULL ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id LIMIT 20")
def random_preview(spark: SparkSession, d: str) -> DataFrame:
    """Twenty texts at random, the same for the same seed (a preview is the feature)."""
    x = _t(spark, d, "documents").filter("text is not null")
    return x.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42"))), "doc_id").limit(20).select("doc_id", F.substring("text", 1, 80).alias("preview"))


# --- records ------------------------------------------------------------------


@query(
    "SELECT comment_id, text, video_id, channel, coalesce(scrape_date, '2024-01-01') AS scrape_date, coalesce(source_type, 'comment') AS source_type, parent_id, CASE WHEN video_id IS NOT NULL THEN 'https://video.example/watch?v=' || video_id || '&lc=' || comment_id END AS url FROM youtube_comments WHERE comment_id IS NOT NULL"
)
def raw_comment_records(spark: SparkSession, d: str) -> DataFrame:
    """Raw comment records: fixed fields, a date for those without, the address by a template."""
    c = _t(spark, d, "youtube_comments").filter("comment_id is not null")
    url = F.when(F.col("video_id").isNotNull(), F.format_string("https://video.example/watch?v=%s&lc=%s", "video_id", "comment_id"))
    return c.select("comment_id", "text", "video_id", "channel", F.coalesce("scrape_date", F.lit("2024-01-01")).alias("scrape_date"), F.coalesce("source_type", F.lit("comment")).alias("source_type"), "parent_id", url.alias("url"))


_PLACED = rf"regexp_replace(regexp_replace(text, '(?:https?://{S.WS.replace('[', '[^', 1)}+|www\.{S.WS.replace('[', '[^', 1)}+)', '[URL]', 'g'), '@[\p{{L}}\p{{N}}_]+', '[MENTION]', 'g')"


@query(f"SELECT row_id, {_PLACED} AS placed FROM youtube_comments WHERE text IS NOT NULL AND (contains(text, '@') OR contains(text, 'http') OR contains(text, 'www.'))")
def tweet_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """Links and mentions as placeholders without blanks around them."""
    x = _t(spark, d, "youtube_comments").filter(F.col("text").contains("@") | F.col("text").contains("http") | F.col("text").contains("www."))
    links = F.regexp_replace("text", rf"(?:https?://{T.NON_WS}+|www\.{T.NON_WS}+)", "[URL]")
    return x.select("row_id", F.regexp_replace(links, r"@[\p{L}\p{N}_]+", "[MENTION]").alias("placed"))


@query(
    "SELECT doc_id, ext_id, label FROM documents JOIN (SELECT comment_id, arg_max(coalesce(lang_hint, ''), row_id) AS label FROM youtube_comments WHERE comment_id IS NOT NULL GROUP BY comment_id) ON ext_id = comment_id"
)
def label_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the label of their record; of a record that is labelled again the last label holds."""
    labels = _t(spark, d, "youtube_comments").filter("comment_id is not null").groupBy(F.col("comment_id").alias("ext_id")).agg(F.max_by(F.coalesce("lang_hint", F.lit("")), "row_id").alias("label"))
    return _t(spark, d, "documents").select("doc_id", "ext_id").join(labels, "ext_id").select("doc_id", "ext_id", "label")


@query("SELECT channel_id, least(nullif(length(title) % 7, 0), nullif(length(description) % 50, 0)) AS cap FROM channels")
def effective_caps(spark: SparkSession, d: str) -> DataFrame:
    """The least of the caps that are given, by channel; null where none is."""
    own, common = F.nullif(F.length("title") % 7, F.lit(0)), F.nullif(F.length("description") % 50, F.lit(0))
    return _t(spark, d, "channels").select("channel_id", F.least(own, common).cast("bigint").alias("cap"))


@query(
    r"""SELECT script, word, count(*)::BIGINT AS n FROM (
  SELECT 'latin' AS script, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM youtube_comments UNION ALL SELECT 'arabic', unnest(regexp_extract_all(text, '[\x{600}-\x{6ff}]+')) FROM youtube_comments)
GROUP BY ALL HAVING count(*) >= 5"""
)
def word_counts_by_script(spark: SparkSession, d: str) -> DataFrame:
    """Words of either script that occur five times or more: the counts that transliteration weights rest on."""
    c = _t(spark, d, "youtube_comments").filter("text is not null")
    words = F.concat(F.transform(T.ascii_words(F.col("text")), lambda w: F.struct(F.lit("latin").alias("script"), w.alias("word"))), F.transform(T.arabic_words(F.col("text")), lambda w: F.struct(F.lit("arabic").alias("script"), w.alias("word"))))
    return c.select(F.explode(words).alias("x")).groupBy("x.script", "x.word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


_CLIP = "WITH w AS (SELECT source, len({w}) AS n FROM documents WHERE text IS NOT NULL), p AS (SELECT quantile_disc(n, 0.99) AS top FROM w)".replace("{w}", S.words("text"))


@query(f"{_CLIP} SELECT source, least(n, top)::BIGINT AS words, count(*)::BIGINT AS docs, (count(*) * least(n, top))::BIGINT AS weight FROM w, p GROUP BY source, least(n, top)")
def clipped_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Texts by length in words, by source, clipped at the 99th percentile of all; also weighted by length."""
    from ..operators import hotkeys

    w = _t(spark, d, "documents").filter("text is not null").select("source", T.word_count(F.col("text")).alias("n"))
    top = hotkeys.quantiles(w.withColumn("all", F.lit("")), "all", F.col("n"), [0.99]).select(F.col("value").alias("top"))
    # One number.
    c = w.join(F.broadcast(top)).select("source", F.least("n", "top").alias("words")).groupBy("source", "words").agg(F.count(F.lit(1)).alias("docs"))
    return c.withColumn("weight", F.col("docs") * F.col("words"))


# --- vectors --------------------------------------------------------------------

# Pairs of neighbours by id, every eleventh of them with a word that has no vector; the given score is any fixed number.
_PAIRS = "SELECT vec_id AS a, CASE WHEN vec_id % 11 = 0 THEN -1 - vec_id ELSE vec_id + 1 END AS b, label::VARCHAR AS category, (vec_id * 7919 % 1009) / 1009.0 AS score FROM embeddings"
_FOUND = f"SELECT p.*, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS cosine FROM ({_PAIRS}) p LEFT JOIN embeddings x ON x.vec_id = a LEFT JOIN embeddings y ON y.vec_id = b"


def _similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings")
    other = F.when(F.col("vec_id") % 11 == 0, -1 - F.col("vec_id")).otherwise(F.col("vec_id") + 1)
    return v.select(F.col("vec_id").alias("a"), other.alias("b"), F.col("label").cast("string").alias("category"), ((F.col("vec_id") * 7919 % 1009) / F.lit(1009.0)).alias("score"))


@query(f"SELECT category, count(*)::BIGINT AS pairs, count(cosine)::BIGINT AS used, (count(*) - count(cosine))::BIGINT AS oov FROM ({_FOUND}) GROUP BY category")
def vector_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Word pairs whose words both have a vector, and those skipped, by category."""
    found = embeddings.looked_up(_similarity_pairs(spark, d), _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("pairs"), F.count("cosine").alias("used"), F.count_if(F.col("cosine").isNull()).alias("oov"))


_RANKS = """SELECT {c} AS category, count(*)::BIGINT AS n, round(corr(ra, rb), 9) AS spearman FROM (
  SELECT category, rank() OVER ({w} ORDER BY score) + (count(*) OVER (PARTITION BY {p}score) - 1) / 2.0 AS ra, rank() OVER ({w} ORDER BY cosine) + (count(*) OVER (PARTITION BY {p}cosine) - 1) / 2.0 AS rb
  FROM f WHERE cosine IS NOT NULL) {g}"""


@query(
    f"""WITH f AS (SELECT category, score, round(cosine, 12) AS cosine FROM ({_FOUND})), o AS (SELECT category, (count(*) - count(cosine))::BIGINT AS oov FROM f GROUP BY category UNION ALL SELECT 'ALL', (count(*) - count(cosine))::BIGINT FROM f),
r AS ({_RANKS.format(c='category', w='PARTITION BY category', p='category, ', g='GROUP BY category')} UNION ALL {_RANKS.format(c="'ALL'", w='', p='', g='')})
SELECT category, n, oov, spearman FROM r JOIN o USING (category)"""
)
def similarity_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of given scores and cosines by category and of all, with the pairs left out for want of a vector."""
    found = embeddings.looked_up(_similarity_pairs(spark, d), _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))
    both = found.withColumn("cosine", F.round("cosine", 12)).select(F.explode(F.array(F.col("category"), F.lit("ALL"))).alias("category"), "score", "cosine")
    oov = both.groupBy("category").agg(F.count_if(F.col("cosine").isNull()).alias("oov"))
    return embeddings.spearman(both, "score", "cosine", "category").join(oov, "category").select("category", "n", "oov", F.round("spearman", 9).alias("spearman"))


# --- pages --------------------------------------------------------------------------


def _escaped(c: str) -> Column:
    return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _link(forum: str, title: str) -> Column:
    return F.concat(F.lit('<a href="forumdisplay.php?f='), F.col(forum), F.lit('">'), _escaped(title), F.lit("</a>"))


@query(
    f"SELECT category_id, forum_id, {S.strip('title')} AS title, coalesce(is_category, false) AS header FROM forum_tree WHERE title IS NOT NULL AND {S.strip('title')} <> '' AND category_id IS NOT NULL"
)
def html_forum_links(spark: SparkSession, d: str) -> DataFrame:
    """Forum links read back from a page a category: headers from its head, the others from the category's body."""
    t = _t(spark, d, "forum_tree").filter("category_id is not null and title is not null").withColumn("link", _link("forum_id", "title"))
    head = F.concat_ws("", F.collect_list(F.when(F.coalesce("is_category", F.lit(False)), F.concat(F.lit('<tr><td class="tcat x">'), F.col("link"), F.lit("</td></tr>")))))
    body = F.concat_ws("", F.collect_list(F.when(~F.coalesce("is_category", F.lit(False)), F.concat(F.lit("<tr><td>"), F.col("link"), F.col("link"), F.lit("</td></tr>")))))
    page = F.concat(F.lit("<html><table><tbody>"), head, F.lit('</tbody><tbody id="collapseobj_forumbit_1">'), body, F.lit("</tbody></table></html>"))
    pages = t.groupBy("category_id").agg(page.alias("page"))
    headers = pages.select("category_id", F.inline(html.links_column(F.col("page"), header=True))).withColumn("header", F.lit(True))
    others = pages.select("category_id", F.inline(html.links_column(F.col("page"), scope="1"))).withColumn("header", F.lit(False))
    return headers.unionByName(others)


@query(
    f"""WITH p AS (SELECT subforum_id, thread_id, arg_min({S.strip('thread_title')}, row_id) AS title, max(batch_no) AS b FROM forum_posts
WHERE subforum_id IS NOT NULL AND thread_id IS NOT NULL AND thread_title IS NOT NULL AND {S.strip('thread_title')} <> '' AND NOT regexp_matches(thread_title, '[\\t\\n\\r]| {{2}}') GROUP BY ALL)
SELECT subforum_id, thread_id, title, (max(b) OVER (PARTITION BY subforum_id)) > 4 AS has_next FROM p"""
)
def html_thread_pages(spark: SparkSession, d: str) -> DataFrame:
    """Threads and the mark of a next page, read back from a page of a subforum's threads."""
    plain = (T.strip(F.col("thread_title")) != "") & ~F.col("thread_title").rlike(r"[\t\n\r]| {2}")
    p = _t(spark, d, "forum_posts").filter("subforum_id is not null and thread_id is not null and thread_title is not null").filter(plain)
    threads = p.groupBy("subforum_id", "thread_id").agg(F.min_by("thread_title", "row_id").alias("title"), F.max("batch_no").alias("b"))
    row = F.concat(F.lit('<a id="thread_title_'), F.col("thread_id"), F.lit('" href="#">'), _escaped("title"), F.lit("</a>"))
    # A page holds some 500 threads, so a subforum of any size is as many pages as it needs.
    more = threads.groupBy("subforum_id").agg((F.max("b") > 4).alias("more"), F.ceil(F.count(F.lit(1)) / 500).alias("pages"))
    on = threads.join(more.select("subforum_id", "pages"), "subforum_id").withColumn("page_no", F.pmod(F.xxhash64("thread_id"), F.col("pages")))
    pages = on.groupBy("subforum_id", "page_no").agg(F.concat_ws("", F.collect_list(row)).alias("rows")).join(more, "subforum_id")
    page = F.concat(F.lit("<div>"), F.col("rows"), F.lit("</div>"), F.when(F.col("more"), F.lit('<div class="pagenav"><a rel="next" href="#">&gt;</a></div>')).otherwise(F.lit("")))
    x = pages.select("subforum_id", page.alias("page")).select("subforum_id", html.threads_column(F.col("page")).alias("threads"), html.has_next_column(F.col("page")).alias("has_next"))
    return x.select("subforum_id", "has_next", F.inline("threads"))


# --- tokenizers -------------------------------------------------------------------------


@query()
def tokenizer_fertility(spark: SparkSession, d: str) -> DataFrame:
    """Pieces a word by public tokenizer and script, and of all scripts."""
    w = _t(spark, d, "documents").filter("text is not null").select(F.explode(T.words(F.col("text"))).alias("word"))
    counts = w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", T.token_class(F.col("word")).alias("script"), "n")
    return tokenizers.word_fertility(counts)


@query()
def tokenizer_fertility_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Fertility by script, a column a tokenizer."""
    return tokenizer_fertility(spark, d).groupBy("script").pivot("tokenizer", list(tokenizers.NAMES)).agg(F.first("fertility"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def tokenizer_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts decoded from their ids: a byte-level tokenizer gives every text back."""
    ids = tokenizers.ids(F.col("text"), "byte_bpe_50k")
    return _t(spark, d, "documents").filter("text is not null").select("doc_id", ids.alias("ids")).select("doc_id", tokenizers.text_of(F.col("ids"), "byte_bpe_50k").alias("text"))


@query("SELECT doc_id, replace(text, chr(10), ' [NEWLINE] ') AS marked, regexp_replace(replace(text, chr(10), ' [NEWLINE] '), '[ \\t\\n\\f\\r]?\\[NEWLINE\\][ \\t\\n\\f\\r]?', chr(10), 'g') AS restored FROM documents WHERE text IS NOT NULL")
def newline_sentinel(spark: SparkSession, d: str) -> DataFrame:
    """Line feeds as a word and back again."""
    x = _t(spark, d, "documents").filter("text is not null").select("doc_id", tokenizers.keep_newlines(F.col("text")).alias("marked"))
    return x.select("doc_id", "marked", tokenizers.restore_newlines(F.col("marked")).alias("restored"))


QUERIES, ORACLES = query.queries, query.oracles
