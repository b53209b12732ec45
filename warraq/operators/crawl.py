"""Forum trees and crawl state over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reachable(tree: DataFrame, most: int | None = None) -> DataFrame:
    """(forum_id, title, parent_id, category_id, depth) of forums reachable from the roots, level by level.

    ``tree`` has a row a forum.  Private forums are found but not expanded; the first parent wins;
    ``most`` caps the forums by depth, then id.  A level costs one join; depth is that of a forum tree.
    """
    nodes = tree.select("forum_id", "title", "parent_id", "category_id", F.coalesce("is_private", F.lit(False)).alias("private"))
    level = nodes.filter("parent_id is null").withColumn("depth", F.lit(0))
    out, depth = level, 0
    while True:
        depth += 1
        up = level.filter(~F.col("private")).select(F.col("forum_id").alias("parent_id"), F.col("category_id").alias("up"))
        level = nodes.join(up, "parent_id").select("forum_id", "title", "parent_id", F.col("up").alias("category_id"), "private").withColumn("depth", F.lit(depth))
        level = level.join(out.select("forum_id"), "forum_id", "left_anti").dropDuplicates(["forum_id"])
        if level.isEmpty():
            break
        out = out.unionByName(level)
    out = out.select("forum_id", "title", "parent_id", "category_id", "depth")
    return out.orderBy("depth", "forum_id").limit(most) if most is not None else out


def progress(items: DataFrame, entity: str, item: str, cap: int) -> DataFrame:
    """(entity, taken, status): distinct items of each entity up to a cap; raising the cap resumes capped ones."""
    n = items.filter(F.col(entity).isNotNull()).groupBy(entity, item).agg(F.lit(1).alias("one")).groupBy(entity).agg(F.count(item).alias("n"))
    return n.select(entity, F.least("n", F.lit(cap)).cast("bigint").alias("taken"), F.when(F.col("n") > cap, "capped").otherwise("done").alias("status"))


def merge_state(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed state: non-empty new values win, defaults fill what neither has; keys of both sides stay."""
    o, n = old.alias("o"), new.alias("n")
    cols = [c for c in old.columns if c != key]
    merged = [F.coalesce(F.when(F.col(f"n.{c}").cast("string") != "", F.col(f"n.{c}")), F.col(f"o.{c}")).alias(c) for c in cols]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *merged)


def status(entity: DataFrame, found: str, reason: str) -> DataFrame:
    """Status machine pending -> done / comments_disabled / error."""
    r = F.lower(F.coalesce(F.col(reason), F.lit("")))
    s = F.when(r.contains("disabled"), "comments_disabled").when(r != "", "error").when(F.col(found), "done").otherwise("pending")
    return entity.withColumn("status", s)
