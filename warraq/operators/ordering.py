"""Positions in a total order, without one task that orders everything.

Rows are range-partitioned by the order, numbered within their partition, and
shifted by the counts of the partitions before.  The order must be total (end
it with a unique column); nulls come first as Spark sorts them.  An empty table
has no positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def positioned(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with its 1-based position in the order."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Written once, so that a part keeps its rows when one of them is computed again.
    cut = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "positioned")
    sizes = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a part.
    starts = sizes.select("__part", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return cut.withColumn("__in", inside).join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def zipped(left: DataFrame, left_order: list[Column], right: DataFrame, right_order: list[Column]) -> DataFrame:
    """Rows of two ordered tables side by side, as far as the shorter one goes: ``position`` and the columns of both."""
    return positioned(left, left_order).join(positioned(right, right_order), "position")
