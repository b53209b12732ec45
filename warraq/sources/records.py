"""Record schemas, scans and sinks: JSON lines, label files, CoNLL-U, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW_COMMENT = _strings("comment_id", "text", "video_id", "channel", "scrape_date", "source_type", "parent_id")
RAW_POST = _strings("post_id", "text", "thread_id", "thread_title", "thread_url", "subforum_id", "author", "timestamp", "post_url", "scrape_date")
SIMILARITY = T.StructType([*_strings("word1", "word2", "category").fields, T.StructField("score", T.DoubleType()), T.StructField("note", T.StringType())])
ANALOGY = T.StructType([T.StructField("category", T.StringType()), T.StructField("pairs", T.ArrayType(_strings("word_a", "word_b", "note")))])


def strict_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """JSON lines; a broken line fails the scan, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)


def tolerant_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, required: tuple[str, ...] = ("id", "text")) -> DataFrame:
    """JSON lines without broken ones and without rows that miss a required field (an empty first one counts as missing)."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    present = [c for c in required if c in schema.fieldNames()]
    for k, c in enumerate(present):
        df = df.filter(F.col(c).isNotNull() & (F.col(c) != "")) if k == 0 else df.filter(F.col(c).isNotNull())
    return df


def unprocessed(spark: SparkSession, path: str, schema: T.StructType, done: DataFrame) -> DataFrame:
    """JSON lines of the files whose names aren't in ``done`` (file), the file kept as a column."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path).withColumn("file", F.col("_metadata.file_path"))
    return df.join(done.select("file"), "file", "left_anti")


def write_batch(df: DataFrame, path: str, date: str) -> None:
    """Append a day's batch as JSON lines, partitioned by date."""
    df.withColumn("batch_date", F.lit(date)).write.mode("append").partitionBy("batch_date").json(path)


def label_text(spark: SparkSession, path: str) -> DataFrame:
    """(label, text) of ``label,text`` lines; further commas belong to the text, lines without one are dropped."""
    m = r"^\s*\"?([^,\"]*)\"?,(.*)$"
    x = spark.read.text(path).filter(F.col("value").contains(","))
    return x.select(F.regexp_extract("value", m, 1).alias("label"), F.regexp_replace(F.regexp_replace(F.regexp_extract("value", m, 2), '^"|"$', ""), '""', '"').alias("text"))


def sentence_labels(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, label) of a tab-separated label file: header skipped, the last label of an id wins."""
    x = spark.read.text(path, wholetext=True)
    lines = x.select(F.posexplode(F.split("value", r"\r?\n"))).filter((F.col("pos") > 0) & F.col("col").contains("\t"))
    parts = lines.select("pos", F.trim(F.regexp_replace(F.regexp_extract("col", r"^(.*)\t([^\t]*)$", 1), r"^# sent_id = ", "")).alias("sent_id"), F.regexp_extract("col", r"^(.*)\t([^\t]*)$", 2).alias("label"))
    return parts.groupBy("sent_id").agg(F.max_by("label", "pos").alias("label"))


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, text, tokens, lang_tags) a sentence; multiword rows ``a-b`` are skipped."""
    block = spark.read.option("lineSep", "\n\n").text(path).filter(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    rows = F.filter(lines, lambda x: x.rlike(r"^\d+\t"))
    tags = F.filter(F.transform(rows, lambda x: F.regexp_extract(x, r"lang=([A-Za-z_]+)", 1)), lambda t: t != "")
    kinds = F.array_distinct(tags)
    counted = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(tags, lambda t: t == k))))
    return block.select(
        F.regexp_extract("value", r"(?m)^# sent_id = (.*)$", 1).alias("sent_id"), F.regexp_extract("value", r"(?m)^# text = (.*)$", 1).alias("text"), F.size(rows).alias("tokens"), counted.alias("lang_tags")
    )


def merge_tags(sentences: DataFrame) -> DataFrame:
    """(lang, n): the sentences' tag counts added up."""
    return sentences.select(F.explode("lang_tags").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n"))


def valid_similarity(df: DataFrame, categories: list[str]) -> DataFrame:
    """Similarity pairs with a ``reason`` column, null for valid rows."""
    reason = (
        F.when(F.coalesce("word1", F.lit("")) == "", "word1 missing")
        .when(F.coalesce("word2", F.lit("")) == "", "word2 missing")
        .when(~F.coalesce(F.col("score").between(0, 1), F.lit(False)), "score out of range")
        .when(~F.coalesce(F.col("category").isin(categories), F.lit(False)), "unknown category")
    )
    return df.withColumn("reason", reason)


def lines_per_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, n): lines of every file."""
    return spark.read.option("recursiveFileLookup", "true").text(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One document a line; newlines inside become blanks."""
    df.select(F.translate(column, "\r\n", "  ").alias("value")).write.mode("overwrite").text(path)
