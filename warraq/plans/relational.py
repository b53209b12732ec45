"""Joins, set operations, run logs, windows, samples, crawl state, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import crawl, sampling
from ..operators.registry import Registry
from . import sqltext as S

query = Registry()


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_HELD = "(SELECT DISTINCT ext_id FROM documents WHERE batch_no = 9)"
_FLAT = S.strip("replace(replace(text, chr(13), ' '), chr(10), ' ')")


def _flat(x: DataFrame) -> DataFrame:
    return x.withColumn("text", T.strip(F.translate("text", "\r\n", "  "))).filter("text <> ''")


@query(f"SELECT doc_id, ext_id, {_FLAT} AS text FROM documents WHERE ext_id IN {_HELD} AND {_FLAT} <> ''")
def heldout_semi(spark: SparkSession, d: str) -> DataFrame:
    """Held-out documents by an id list (left semi), one line a document."""
    x = _t(spark, d, "documents")
    return _flat(x.join(x.filter("batch_no = 9").select("ext_id").distinct(), "ext_id", "left_semi").select("doc_id", "ext_id", "text"))


@query(f"SELECT doc_id, ext_id, {_FLAT} AS text FROM documents WHERE (ext_id NOT IN (SELECT ext_id FROM {_HELD} WHERE ext_id IS NOT NULL) OR ext_id IS NULL) AND {_FLAT} <> ''")
def train_anti(spark: SparkSession, d: str) -> DataFrame:
    """Training documents: those not held out (left anti)."""
    x = _t(spark, d, "documents")
    return _flat(x.join(x.filter("batch_no = 9").select("ext_id").distinct(), "ext_id", "left_anti").select("doc_id", "ext_id", "text"))


@query("SELECT source, count(*)::BIGINT AS n, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM (SELECT 'youtube' AS source, text FROM youtube_comments UNION ALL SELECT 'djelfa', text FROM forum_posts) GROUP BY source")
def sources_union(spark: SparkSession, d: str) -> DataFrame:
    """Two sources with different records as one (union by name)."""
    a = _t(spark, d, "youtube_comments").select(F.lit("youtube").alias("source"), "text", "video_id")
    b = _t(spark, d, "forum_posts").select(F.lit("djelfa").alias("source"), "text", "thread_id")
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("chars"))


_A, _B = "SELECT channel AS k FROM youtube_comments", "SELECT channel_id AS k FROM channels"


@query(
    f"SELECT 'union' AS op, count(*)::BIGINT AS n FROM ({_A} UNION {_B}) UNION ALL SELECT 'intersect', count(*)::BIGINT FROM ({_A} INTERSECT {_B}) UNION ALL SELECT 'except', count(*)::BIGINT FROM ({_A} EXCEPT {_B}) UNION ALL SELECT 'to_fetch', count(*)::BIGINT FROM (SELECT DISTINCT k FROM ({_A}) WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM ({_B})))"
)
def key_setops(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection, difference of key sets, and the keys still to fetch (anti join)."""
    a, b = _t(spark, d, "youtube_comments").select(F.col("channel").alias("k")).distinct(), _t(spark, d, "channels").select(F.col("channel_id").alias("k"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "to_fetch": a.filter("k is not null").join(b, "k", "left_anti")}
    out = None
    for op, x in parts.items():
        row = x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT count(*)::BIGINT AS texts, sum(c)::BIGINT AS records, coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS in_groups, max(c)::BIGINT AS largest FROM (SELECT count(*) AS c FROM youtube_comments WHERE text IS NOT NULL GROUP BY text)")
def exact_dups(spark: SparkSession, d: str) -> DataFrame:
    """Exact duplicates: distinct texts, rows in groups of more than one."""
    # Grouped by a 128-bit digest, so that texts aren't shuffled.
    key = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), F.reverse("text")))
    g = _t(spark, d, "youtube_comments").filter("text is not null").groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.count(F.lit(1)).alias("texts"), F.sum("c").alias("records"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).cast("bigint").alias("in_groups"), F.max("c").alias("largest"))


@query("SELECT c.row_id, p.row_id AS parent_row, p.batch_no > c.batch_no AS parent_later FROM youtube_comments c LEFT JOIN (SELECT comment_id, min(row_id) AS row_id, min_by(batch_no, row_id) AS batch_no FROM youtube_comments GROUP BY comment_id) p ON c.parent_id = p.comment_id WHERE c.source_type = 'reply'")
def reply_parent(spark: SparkSession, d: str) -> DataFrame:
    """Replies with their parent's first delivery, if there is one."""
    x = _t(spark, d, "youtube_comments")
    p = x.groupBy("comment_id").agg(F.min("row_id").alias("parent_row"), F.min_by("batch_no", "row_id").alias("pb")).withColumnRenamed("comment_id", "parent_id")
    return x.filter("source_type = 'reply'").join(p, "parent_id", "left").select("row_id", "parent_row", (F.col("pb") > F.col("batch_no")).alias("parent_later"))


@query("SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY comment_id ORDER BY row_id) AS r FROM youtube_comments) WHERE r = 1")
def first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """First delivery of each comment."""
    # A minimum per key instead of a window: combined before the shuffle.
    return _t(spark, d, "youtube_comments").groupBy("comment_id").agg(F.min("row_id").alias("row_id")).select("row_id")


@query("SELECT channel, row_id, r::INT AS place FROM (SELECT channel, row_id, row_number() OVER (PARTITION BY channel ORDER BY scrape_date DESC, row_id DESC) AS r FROM youtube_comments WHERE channel IS NOT NULL) WHERE r <= 5")
def newest_n_per_entity(spark: SparkSession, d: str) -> DataFrame:
    """The five newest comments of every channel; Spark keeps only five a key and task before the shuffle."""
    w = Window.partitionBy("channel").orderBy(F.desc("scrape_date"), F.desc("row_id"))
    x = _t(spark, d, "youtube_comments").filter("channel is not null").select("channel", "row_id", "scrape_date")
    return x.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("channel", "row_id", "place")


@query("SELECT c.channel AS channel_id, coalesce(nullif(d.title, ''), '(unknown)') AS title, substring(d.description, 1, 200) AS description, c.n FROM (SELECT channel, count(*)::BIGINT AS n FROM youtube_comments WHERE channel IS NOT NULL GROUP BY channel) c LEFT JOIN channels d ON d.channel_id = c.channel")
def channel_dimension_merge(spark: SparkSession, d: str) -> DataFrame:
    """Channels with counts, merged with the dimension: empty values give way to defaults."""
    n = _t(spark, d, "youtube_comments").filter("channel is not null").groupBy(F.col("channel").alias("channel_id")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(_t(spark, d, "channels"), "channel_id", "left").select("channel_id", F.coalesce(F.nullif("title", F.lit("")), F.lit("(unknown)")).alias("title"), F.substring("description", 1, 200).alias("description"), "n")


@query(
    "SELECT coalesce(subforum_id, CASE WHEN grouping(subforum_id) = 1 THEN 'ALL' ELSE '_none' END) AS subforum, coalesce(batch_no, -1) AS run, count(*)::BIGINT AS collected, count(*) FILTER (coalesce(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 0) < 2)::BIGINT AS dropped_empty FROM forum_posts GROUP BY GROUPING SETS ((subforum_id, batch_no), (batch_no), (subforum_id), ())"
)
def run_log_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Counters by run and subforum, run totals, cumulative by subforum, grand total: one pass of grouping sets."""
    x = _t(spark, d, "forum_posts").select("subforum_id", "batch_no", (F.coalesce(F.length(F.regexp_replace("text", r"[^\p{L}]", "")), F.lit(0)) < 2).alias("e"))
    base = x.groupBy("subforum_id", "batch_no").agg(F.count(F.lit(1)).alias("c"), F.count_if("e").alias("d"))
    g = base.cube("subforum_id", "batch_no").agg(F.grouping("subforum_id").alias("g"), F.sum("c").alias("collected"), F.sum("d").alias("dropped_empty"))
    return g.select(F.coalesce("subforum_id", F.when(F.col("g") == 1, "ALL").otherwise("_none")).alias("subforum"), F.coalesce("batch_no", F.lit(-1)).alias("run"), "collected", "dropped_empty")


@query("SELECT event_type, hour(ts)::INT AS hour, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def crosstab_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and hour."""
    return _t(spark, d, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("SELECT ts::DATE AS day, sum(CASE event_type WHEN 'purchase' THEN 100 ELSE 1 END)::BIGINT AS units, sum(CASE event_type WHEN 'purchase' THEN 100 ELSE 1 END) > 10000 AS over_quota FROM events GROUP BY 1")
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    """Quota units a day, at costs 1 and 100, against the budget of 10,000."""
    cost = F.sum(F.when(F.col("event_type") == "purchase", 100).otherwise(1))
    return _t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(cost.alias("units"), (cost > 10000).alias("over_quota"))


@query("SELECT event_type, count(*)::BIGINT AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """A number out of a JSON column."""
    return _t(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("p")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("total"))


@query("SELECT channel_id, ((row_number() OVER (ORDER BY channel_id) - 1) // 50)::BIGINT AS request FROM channels")
def batches_of_50(spark: SparkSession, d: str) -> DataFrame:
    """Ids in requests of 50 (a dimension of fixed size)."""
    return _t(spark, d, "channels").select("channel_id", F.floor((F.row_number().over(Window.orderBy("channel_id")) - 1) / 50).alias("request"))


_RANK = "row_number() OVER (PARTITION BY {s} ORDER BY md5(doc_id::VARCHAR || ':{seed}'), doc_id)"


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, {_RANK.format(s='source', seed=42)} AS r FROM documents) WHERE r <= 100")
def reservoir_k_per_source(spark: SparkSession, d: str) -> DataFrame:
    """Exactly 100 documents a source (a sampling operator)."""
    return sampling.reservoir(_t(spark, d, "documents"), "doc_id", "source", 100, 42)


@query(f"SELECT doc_id FROM (SELECT doc_id, {_RANK.format(s='channel', seed=42)} AS r, count(*) OVER (PARTITION BY channel) AS n FROM documents) WHERE r <= round(n * 0.2)")
def stratified_20pct(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of every channel, null a stratum of its own."""
    return sampling.stratified_fraction(_t(spark, d, "documents"), "doc_id", "channel", 0.2, 42)


@query(f"SELECT doc_id, source, CASE WHEN r <= 10 THEN 'dev' WHEN r <= 20 THEN 'test' ELSE 'train' END AS part FROM (SELECT doc_id, source, {_RANK.format(s='source', seed=7)} AS r FROM documents)")
def train_dev_test(spark: SparkSession, d: str) -> DataFrame:
    """Ten dev and ten test documents a source, the rest train."""
    return sampling.split(_t(spark, d, "documents"), "doc_id", "source", 20, 7)


@query("SELECT doc_id, CASE WHEN u < 0.6 THEN 'el' WHEN u < 0.9 THEN 'l' ELSE 'al' END AS choice FROM (SELECT doc_id, ('0x' || substring(md5('c' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents)")
def weighted_choice(spark: SparkSession, d: str) -> DataFrame:
    """A weighted choice a row by hash."""
    key = F.concat(F.lit("c"), F.col("doc_id").cast("string"))
    return _t(spark, d, "documents").select("doc_id", sampling.weighted_choice(key, [("el", 0.6), ("l", 0.3), ("al", 0.1)]).alias("choice"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id)::BIGINT AS place FROM documents")
def deterministic_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Place of every document in the seeded order, by bins."""
    x = _t(spark, d, "documents").select("doc_id", F.lit(0).alias("all"))
    return sampling.ranked(x, "doc_id", "all", 42).select("doc_id", F.col("rank").alias("place"))


@query("SELECT v.* FROM (VALUES ('https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=30s', 'dQw4w9WgXcQ'), ('https://youtu.be/dQw4w9WgXcQ?si=x', 'dQw4w9WgXcQ'), ('https://www.youtube.com/shorts/dQw4w9WgXcQ', 'dQw4w9WgXcQ'), ('dQw4w9WgXcQ', 'dQw4w9WgXcQ'), ('https://example.test/x', NULL)) v(url, video_id)")
def url_parse(spark: SparkSession, d: str) -> DataFrame:
    """Video ids of URL shapes."""
    urls = ["https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=30s", "https://youtu.be/dQw4w9WgXcQ?si=x", "https://www.youtube.com/shorts/dQw4w9WgXcQ", "dQw4w9WgXcQ", "https://example.test/x"]
    return spark.createDataFrame([(u,) for u in urls], "url string").select("url", T.video_id(F.col("url")).alias("video_id"))


@query("SELECT * FROM (VALUES ('0,5', 0.5::DOUBLE, '0,5'), (' 1,25 ', 1.25, ' 1,25 '), ('nan', 'nan'::DOUBLE, NULL), ('x', NULL, 'x')) v(raw, number, emotion)")
def comma_decimal_nan(spark: SparkSession, d: str) -> DataFrame:
    """Comma decimals and a missing-value string."""
    x = spark.createDataFrame([("0,5",), (" 1,25 ",), ("nan",), ("x",)], "raw string")
    return x.select("raw", T.comma_decimal(F.col("raw")).alias("number"), T.sentinel_null(F.col("raw")).alias("emotion"))


_BFS = """WITH RECURSIVE tree AS (SELECT forum_id, title, parent_id, category_id, 0 AS depth, is_private FROM forum_tree WHERE parent_id IS NULL
  UNION ALL SELECT f.forum_id, f.title, f.parent_id, t.category_id, t.depth + 1, f.is_private FROM forum_tree f JOIN tree t ON f.parent_id = t.forum_id WHERE NOT coalesce(t.is_private, false))
SELECT forum_id, title, parent_id, category_id, depth FROM tree"""


@query(_BFS)
def forum_tree_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Forums reachable from the roots; private ones are not expanded, children take the root's category."""
    return crawl.reachable(_t(spark, d, "forum_tree"))


@query("SELECT forum_id, title, url FROM forum_tree WHERE NOT is_category AND NOT is_private")
def crawl_targets(spark: SparkSession, d: str) -> DataFrame:
    """Forums to read: no category, not private."""
    return _t(spark, d, "forum_tree").filter(~F.col("is_category") & ~F.col("is_private")).select("forum_id", "title", "url")


@query("SELECT thread_id, least(count(DISTINCT post_id), 40)::BIGINT AS taken, CASE WHEN count(DISTINCT post_id) > 40 THEN 'capped' ELSE 'done' END AS status FROM forum_posts WHERE thread_id IS NOT NULL GROUP BY thread_id")
def resume_status(spark: SparkSession, d: str) -> DataFrame:
    """Progress of every thread under a cap of 40 posts."""
    return crawl.progress(_t(spark, d, "forum_posts"), "thread_id", "post_id", 40)


@query("SELECT category_title, list(title ORDER BY title, forum_id) AS titles FROM forum_tree GROUP BY category_title")
def regroup_lists(spark: SparkSession, d: str) -> DataFrame:
    """Flat rows as one row a category with a sorted list."""
    g = _t(spark, d, "forum_tree").groupBy("category_title").agg(F.sort_array(F.collect_list(F.struct("title", "forum_id"))).alias("x"))
    return g.select("category_title", F.col("x.title").alias("titles"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling one-hour windows."""
    return _t(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


QUERIES, ORACLES = query.queries, query.oracles
