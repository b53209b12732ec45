"""Registered queries of the problems tagged llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import history, language, mixing, pii, residue, splitting, terms, tokens


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Batches that p2_found admits as one delivery; the result doesn't depend on it.
BATCHES = 3
TABLES = {"documents": "doc_id", "youtube_comments": "row_id", "forum_posts": "row_id"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records and kinds of personal information in their texts."""
    names = pii.read_names(_t(spark, d, "given_names"))
    # A record is a row, so kinds are made distinct by row where they are found.
    parts = [pii.kinds(_t(spark, d, t), i, "text", names).select(F.lit(t).alias("tbl"), F.col("rec_id").cast("bigint").alias("rec_id"), "kind") for t, i in TABLES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold personal information, with typed placeholders in its place."""
    names = pii.read_names(_t(spark, d, "given_names"))
    parts = []
    for t, i in TABLES.items():
        df = _t(spark, d, t).filter("text is not null").select(F.lit(t).alias("tbl"), F.col(i).alias("rec_id"), "text", pii.redact(F.col("text"), names).alias("redacted"))
        parts.append(df.filter("text <> redacted").drop("text"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of batches 1 to 9 that repeat a row accepted before them, with the first accepted one.

    The forest is made of batch 0; later batches come in deliveries of ``BATCHES``, each of which is looked up in the
    forest and leaves its accepted texts there; small runs are merged as they gather.
    """
    spaces = {"documents": ("doc_id", F.col("source") == "djelfa_info"), "youtube_comments": ("row_id", F.lit(False))}

    def delivery(which: Column) -> DataFrame:
        parts = []
        for space, (t, (i, post)) in enumerate(spaces.items()):
            own = _t(spark, d, t).filter(which)
            parts.append(own.select(history.order_of(space, F.col("batch_no"), F.col(i)).alias("ord"), F.coalesce(post, F.lit(False)).alias("post"), "text"))
        return parts[0].unionByName(parts[1])

    later = [_t(spark, d, t).select("batch_no").filter("batch_no > 0").distinct() for t in spaces]
    forest = history.build(spark, delivery(F.col("batch_no") == 0))
    found = []
    numbers = sorted(r[0] for r in later[0].union(later[1]).distinct().collect())
    for k in range(0, len(numbers), BATCHES):
        if len(forest.runs) >= history.RUNS:
            forest.merge()
        found.append(history.admit(forest, delivery(F.col("batch_no").isin(numbers[k : k + BATCHES]))))
    forest.drop()
    out = found[0] if found else spark.createDataFrame([], "dup bigint, kept bigint")
    for f in found[1:]:
        out = out.unionByName(f)
    names = F.element_at(F.array(*[F.lit(t) for t in spaces]), history.space_of(F.col("dup")) + 1)
    return out.select(names.alias("tbl"), history.row_of(F.col("kept")).alias("kept_id"), history.row_of(F.col("dup")).alias("dup_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that are residue instead of what a person wrote."""
    ratios = residue.fit(residue.read_prose(_t(spark, d, "lang_samples")))
    parts = [
        residue.flag(_t(spark, d, t), TABLES[t], "text", ratios).select(F.lit(t).alias("tbl"), F.col("rec_id").cast("bigint").alias("rec_id")) for t in ("documents", "forum_posts")
    ]
    return parts[0].unionByName(parts[1])


def p3_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents without the residue."""
    ratios = residue.fit(residue.read_prose(_t(spark, d, "lang_samples")))
    return residue.exclude(_t(spark, d, "documents").select("doc_id", "source", "text"), "text", ratios)


def _terms(spark: SparkSession, d: str, tbl: str) -> DataFrame:
    return terms.marked(_t(spark, d, tbl)).select(F.lit(tbl).alias("tbl"), "term", "occurrences", "records", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term of documents and comments with its occurrences, records and mark."""
    return _terms(spark, d, "documents").unionByName(_terms(spark, d, "youtube_comments"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that are too rare or too common."""
    return p4_terms(spark, d).filter("mark is not null").select("tbl", "term", "mark")


def p5_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Token totals of documents by source, language and domain, and of comments by channel."""
    docs = tokens.token_budget(_t(spark, d, "documents"), ["source", "lang", "domain"])
    comments = tokens.token_budget(_t(spark, d, "youtube_comments"), ["channel"])
    cols = ["tbl", "level", "source", "lang", "domain", "channel", "records", "null_texts", "empty_texts", "chars", "tokens"]
    none = F.lit(None).cast("string")
    return (
        docs.withColumns({"tbl": F.lit("documents"), "channel": none})
        .select(cols)
        .unionByName(comments.withColumns({"tbl": F.lit("youtube_comments"), "source": none, "lang": none, "domain": none}).select(cols))
    )


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return tokens.encode(_t(spark, d, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mix with their number of uses."""
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets")).documents


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of all tokens reached, beside the targets."""
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets")).shares


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every document longer than a row of split_limits allows."""
    return splitting.split(_t(spark, d, "documents"), splitting.read_limits(_t(spark, d, "split_limits")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a missing or wrong label, and the lines of mixed documents, with the right language."""
    samples = _t(spark, d, "lang_samples")
    profiles = language.fit(language.read_samples(samples))
    ratios = residue.fit(residue.read_prose(samples))
    docs = language.relabelled(_t(spark, d, "documents"), "doc_id", "text", "lang", profiles, ratios)
    comments = language.relabelled(_t(spark, d, "youtube_comments"), "row_id", "text", "lang_hint", profiles, lines=False)
    parts = [x.select(F.lit(t).alias("tbl"), F.col("rec_id").cast("bigint").alias("rec_id"), "seg_no", "lang") for t, x in (("documents", docs), ("youtube_comments", comments))]
    return parts[0].unionByName(parts[1])


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every document and comment, and of the lines of mixed documents."""
    profiles = language.fit(language.read_samples(_t(spark, d, "lang_samples")))
    docs = language.segments(_t(spark, d, "documents"), "doc_id", "text", profiles)
    comments = language.segments(_t(spark, d, "youtube_comments"), "row_id", "text", profiles, lines=False)
    return docs.withColumn("tbl", F.lit("documents")).unionByName(comments.withColumn("tbl", F.lit("youtube_comments"))).select("tbl", "rec_id", "seg_no", "lang", "confidence")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_redacted, p2_found, p3_found, p3_clean_documents, p4_found, p4_terms, p5_token_budget, p7_found, p7_languages, p8_ids, p9_mix, p9_shares, p10_pieces)
}

_TERMS = """
WITH t AS (SELECT {i} AS id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: NOT regexp_full_match(x, '\\p{{Nd}}+'))) AS term FROM {t}),
n AS (SELECT count(text) AS texts FROM {t})
SELECT '{t}' AS tbl, term, count(*)::BIGINT AS occurrences, count(DISTINCT id)::BIGINT AS records,
       CASE WHEN count(DISTINCT id) = 1 THEN 'rare' WHEN count(DISTINCT id) > 0.05 * any_value(texts) THEN 'common' END AS mark
FROM t, n GROUP BY term"""
_ALL_TERMS = " UNION ALL ".join(f"SELECT * FROM ({_TERMS.format(t=t, i=i)})" for t, i in (("documents", "doc_id"), ("youtube_comments", "row_id")))

ORACLES: dict[str, str] = {
    "p4_terms": _ALL_TERMS,
    "p4_found": f"SELECT tbl, term, mark FROM ({_ALL_TERMS}) WHERE mark IS NOT NULL",
}
