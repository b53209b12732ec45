"""Per-key results where a few keys hold most rows (problem 6), without imbalance.

Sums, counts, distinct items and latest dates: rows are first aggregated by
(key, item) - a hot key's items spread over all tasks - and those partial rows
by key, both with map-side combination.

Exact quantiles per key: distributed selection by counts.  Rows become counts
by (key, value); then a histogram of the values' high digits per key says in
which bin each wanted rank lies, and only the counts inside those bins go on to
the next digit, until the value is known.  What is shuffled is counts; a key's
values are never gathered, and a window never sees more than one histogram.

Hot keys: the same refinement over the hashes of the keys.  A bin with less
than the wanted share of all rows can't hold a hot key, so only the few others
are counted by the next digit, and by key at last.

Defined cases: a null key is a group of its own; null items aren't counted as
distinct; null values have no rank (a key with no others has no row of quantiles);
repeated rows count as often as they come; ties need no rule, as equal values
are one bin; an empty table gives no rows.  Column names of the input are
free, as the operator renames what it reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bits of a histogram digit: bins per key and refinement step.
DIGIT = 8
#: Digits of a key's hash that are refined before the keys themselves are counted.
HASH_DIGITS = 2


def per_key(df: DataFrame, key: str, item: str, text: str, date: str) -> DataFrame:
    """(key_value, records, items, chars, latest): one row a key, the null key included."""
    slim = df.select(F.col(key).alias("key_value"), F.col(item).alias("__item"), F.col(text).alias("__text"), F.col(date).alias("__date"))
    parts = slim.groupBy("key_value", "__item").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("__text")).alias("c"), F.max("__date").alias("d")
    )
    return parts.groupBy("key_value").agg(
        F.sum("n").alias("records"), F.count("__item").alias("items"), F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("chars"), F.max("d").alias("latest")
    )


def hot_keys(results: DataFrame, share: float = 0.03) -> DataFrame:
    """(key_value, records, share): keys with at least that share of all rows; null keys count as rows only."""
    total = results.agg(F.sum("records").alias("total"))
    # One row, so the join is a broadcast of a single number.
    return (
        results.join(F.broadcast(total))
        .filter(F.col("key_value").isNotNull() & (F.col("records") >= F.lit(share) * F.col("total")))
        .select("key_value", "records", (F.col("records") / F.col("total")).alias("share"))
    )


def heavy_keys(df: DataFrame, key: str, share: float = 0.03) -> DataFrame:
    """(key_value, records, share): keys with at least that share of all rows, by refined histograms; null keys count as rows only.

    At most ``1 / share`` bins are wanted at a level: their numbers are all that reaches the driver, whatever the keys are.
    """
    keys = df.select(F.col(key).alias("key_value"))
    total, bins = keys.count(), [0]
    inside = keys.filter("key_value is not null").withColumn("hash", F.xxhash64("key_value"))
    for level in range(1, HASH_DIGITS + 1):
        prefix = F.shiftrightunsigned("hash", 64 - level * DIGIT)
        hist = inside.groupBy(prefix.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        bins = [r["bin"] for r in hist.filter(F.col("n") >= F.lit(share) * F.lit(total)).collect()]
        inside = inside.filter(prefix.isin(bins) if bins else F.lit(False))
    counts = inside.groupBy("key_value").agg(F.count(F.lit(1)).alias("records"))
    return counts.filter(F.col("records") >= F.lit(share) * F.lit(total)).select("key_value", "records", (F.col("records") / F.lit(float(max(total, 1)))).alias("share"))


def _digit(value: Column, level: int) -> Column:
    return F.shiftright(value, level * DIGIT)


def quantiles(df: DataFrame, key: str, value: Column, probs: Sequence[float], bits: int | None = None) -> DataFrame:
    """(key_value, prob, n, value): the exact lower quantile (rank ``ceil(p*n)``, at least 1) of a non-negative integer.

    Refinement takes as many steps as the largest value has digits, each over the counts in the wanted bins of the step
    before; a negative value is an error, and one of ``bits`` bits or more, if that is given.
    """
    counts = df.select(F.col(key).alias("key_value"), value.cast("bigint").alias("v")).filter("v is not null").groupBy("key_value", "v").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "counts")
    least, most = counts.agg(F.min("v"), F.max("v")).first()
    if least is not None and least < 0:
        raise ValueError(f"quantiles are of non-negative integers, not of {least}")
    if bits is not None and (most or 0) >> bits:
        raise ValueError(f"{most} has more than {bits} bits")
    levels = max(1, -(-(most or 0).bit_length() // DIGIT))
    want = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    state = (
        counts.groupBy("key_value")
        .agg(F.sum("n").alias("total"))
        .select("key_value", "total", want)
        .select("key_value", "total", "prob", F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("total"))).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("prefix"))
    )
    for level in reversed(range(levels)):
        if level < levels - 1:
            # What lies outside all wanted bins is not looked at again.
            bins = state.select(F.col("key_value").alias("k"), F.col("prefix").alias("p")).distinct()
            counts = stored(counts.join(bins, F.col("key_value").eqNullSafe(F.col("k")) & (_digit(F.col("v"), level + 1) == F.col("p")), "left_semi"), "counts")
        hist = counts.groupBy("key_value", _digit(F.col("v"), level + 1).alias("prefix"), _digit(F.col("v"), level).alias("bin")).agg(F.sum("n").alias("n"))
        inside = state.alias("s").join(hist.alias("h"), F.col("s.key_value").eqNullSafe(F.col("h.key_value")) & (F.col("s.prefix") == F.col("h.prefix")))
        order = Window.partitionBy("key_value", "prob").orderBy("bin")
        found = inside.select("s.key_value", "total", "prob", "rank", "bin", "n").withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        state = stored(
            found.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(
                "key_value", "total", "prob", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), F.col("bin").alias("prefix")
            ),
            "state",
        )
    return state.select("key_value", "prob", F.col("total").alias("n"), F.col("prefix").alias("value"))
