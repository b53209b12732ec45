"""Deterministic samples and splits by hashed keys: exact sizes, retry-safe, the same in SQL.

A row's place in the random order is ``md5(id || seed)``.  Counts of leading
hex digits (mergeable) tell in which bin of a stratum a wanted rank lies: only
the rows of such bins are ordered, all others are in or out by their bin.
``ranked`` orders all rows, bin by bin, for those who want every rank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading hex digits of the bins.
DIGITS = 3


def place(id_col: Column, seed: int) -> Column:
    """Position key of a row."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))


def _binned(df: DataFrame, id_col: str, stratum: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their hash and bin, and by (stratum, bin) the rows of it, before it and of the stratum."""
    x = df.select(F.col(id_col), F.col(stratum), place(F.col(id_col), seed).alias("__h")).withColumn("__b", F.substring("__h", 1, DIGITS))
    sizes = x.groupBy(stratum, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(stratum).orderBy("__b")
    before = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    # The stratum is compared null-safe: a null stratum is one of its own.
    return x, sizes.select(F.col(stratum).alias("__s"), F.col("__b").alias("__sb"), "__n", before.alias("__before"), F.sum("__n").over(Window.partitionBy(stratum)).alias("size"))


def _inside(id_col: str, stratum: str) -> Column:
    return F.row_number().over(Window.partitionBy(stratum, "__b").orderBy("__h", id_col))


def ranked(df: DataFrame, id_col: str, stratum: str, seed: int) -> DataFrame:
    """(id, stratum, rank, size): exact ranks within strata, ordering only inside (stratum, bin) groups."""
    x, s = _binned(df, id_col, stratum, seed)
    y = x.withColumn("__in", _inside(id_col, stratum))
    return y.join(s, y[stratum].eqNullSafe(s["__s"]) & (y["__b"] == s["__sb"])).select(id_col, stratum, (F.col("__before") + F.col("__in")).alias("rank"), "size")


def slots(df: DataFrame, id_col: str, stratum: str, seed: int, ends: Callable[[Column], list[Column]]) -> DataFrame:
    """(id, stratum, slot): how many of the ends (ranks, from the stratum's size) a row lies beyond; only bins that an end cuts are ordered."""
    x, s = _binned(df, id_col, stratum, seed)
    to = ends(F.col("size"))
    cut = F.lit(False)
    for e in to:
        cut = cut | ((F.col("__before") < e) & (e < F.col("__before") + F.col("__n")))
    beyond = lambda rank: sum(((rank > e).cast("int") for e in to), F.lit(0))
    y = x.join(s.withColumn("__cut", cut), x[stratum].eqNullSafe(s["__s"]) & (x["__b"] == s["__sb"]))
    whole = y.filter(~F.col("__cut")).select(id_col, stratum, beyond(F.col("__before") + 1).alias("slot"))
    edge = y.filter("__cut").withColumn("__in", _inside(id_col, stratum)).select(id_col, stratum, beyond(F.col("__before") + F.col("__in")).alias("slot"))
    return whole.unionByName(edge)


def reservoir(df: DataFrame, id_col: str, stratum: str, k: int, seed: int) -> DataFrame:
    """(id, stratum): exactly k rows a stratum (all, if it has fewer)."""
    return slots(df, id_col, stratum, seed, lambda _: [F.lit(k)]).filter("slot = 0").select(id_col, stratum)


def stratified_fraction(df: DataFrame, id_col: str, stratum: str, fraction: float, seed: int) -> DataFrame:
    """(id): round(fraction * size) rows of every stratum."""
    return slots(df, id_col, stratum, seed, lambda size: [F.round(size * F.lit(fraction))]).filter("slot = 0").select(id_col)


def split(df: DataFrame, id_col: str, stratum: str, held: int, seed: int) -> DataFrame:
    """(id, stratum, part): the first half of ``held`` rows dev, the next test, the rest train, by stratum."""
    parts = slots(df, id_col, stratum, seed, lambda _: [F.lit(held // 2), F.lit(held)])
    return parts.select(id_col, stratum, F.element_at(F.array(F.lit("dev"), F.lit("test"), F.lit("train")), F.col("slot") + 1).alias("part"))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of a hash."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def weighted_choice(key: Column, options: list[tuple[str, float]]) -> Column:
    """One of few options by weight: inverse of the cumulative distribution at a hashed uniform."""
    u = uniform(key) * F.lit(sum(w for _, w in options))
    upto, out = 0.0, None
    for name, w in options[:-1]:
        upto += w
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(options[-1][0]) if out is not None else F.lit(options[0][0])
