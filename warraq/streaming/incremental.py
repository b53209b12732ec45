"""Incremental comment pipeline: new files, cleaned, near-duplicates of kept texts dropped, each file once.

A run reads the files that are new since the checkpoint (``availableNow``), and
each micro-batch writes its documents, bands and run counters to folders named
by the batch: a batch that is repeated after a failure overwrites itself, so
nothing is lost or doubled.

Rows are numbered exactly, in order of file path and line, so that of near-copies
the first to arrive is kept whatever its comment id: ids may be null or repeated.
No row is dropped but empty and near-duplicate ones, and both are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clean import clean_comment
from ..operators import neardup
from ..sources.records import RAW_COMMENT

BANDS = "id bigint, band int, key bigint"
RUNS = "collected bigint, dropped_empty bigint, dropped_repeats bigint, retained bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path) if there else spark.createDataFrame([], schema)


def numbered(df: DataFrame, no: int) -> DataFrame:
    """``df`` (.., path, block) with ``id``: the batch's number above 40 bits of the row's place in it, by path, block and line.

    A block of a file is read by one task in order, so the running number of the scan orders its lines. Windows
    hold one block; only one row a block is ordered by itself.
    """
    rows = df.withColumn("line", F.monotonically_increasing_id()).withColumn("line", F.row_number().over(Window.partitionBy("path", "block").orderBy("line")))
    before = F.coalesce(F.sum("n").over(Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = df.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n")).select("path", "block", before.alias("before"))
    place = F.shiftleft(F.lit(no).cast("bigint"), 40).bitwiseOR(F.col("before") + F.col("line") - 1)
    return rows.join(starts, ["path", "block"]).withColumn("id", place).drop("path", "block", "line", "before")


def run(spark: SparkSession, raw: str, out: str) -> None:
    """Process what is new in ``raw``; results under ``out``/docs, bands, runs."""
    stream = spark.readStream.schema(RAW_COMMENT).json(raw).withColumn("file", F.col("_metadata.file_name")).withColumn("path", F.col("_metadata.file_path")).withColumn("block", F.col("_metadata.file_block_start"))

    def batch(df: DataFrame, no: int) -> None:
        seen = numbered(df, no).withColumn("text", clean_comment(F.col("text"))).persist()
        full = seen.filter("text is not null")
        index = _read(spark, f"{out}/bands", BANDS).filter(F.shiftright("id", 40) < no)
        decided = neardup.keep_first(full, "id", "text", index)
        docs = full.join(decided.filter("kept").select("id"), "id", "left_semi").persist()
        docs.write.mode("overwrite").parquet(f"{out}/docs/batch={no}")
        sig = docs.select("id", neardup.signature(F.col("text")).alias("sig"))
        neardup.bands(sig, "id", "sig").select("id", "band", "key").write.mode("overwrite").parquet(f"{out}/bands/batch={no}")
        counts = seen.agg(F.count(F.lit(1)).alias("collected"), F.count_if(F.col("text").isNull()).alias("dropped_empty"))
        counts = counts.join(docs.agg(F.count(F.lit(1)).alias("retained"))).withColumn("dropped_repeats", F.col("collected") - F.col("dropped_empty") - F.col("retained"))
        counts.write.mode("overwrite").parquet(f"{out}/runs/batch={no}")
        docs.unpersist()
        seen.unpersist()

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def run_log(spark: SparkSession, out: str) -> DataFrame:
    """Cumulative counters of all runs; runs of before there was a count of repeats have it from the others."""
    runs = _read(spark, f"{out}/runs", RUNS).withColumn("dropped_repeats", F.coalesce("dropped_repeats", F.col("collected") - F.col("dropped_empty") - F.col("retained")))
    return runs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("collected", "dropped_empty", "dropped_repeats", "retained")])
