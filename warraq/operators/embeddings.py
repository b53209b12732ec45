"""Evaluation of word vectors: cosine, neighbours, rank correlation, analogies.

Vectors are arrays of numbers; a null or zero vector has cosine 0 with
everything.  Neighbour search runs a stated query set against all rows in
blocks: the queries are cut into blocks of bounded size, a block is a matrix in
a task, and the vectors stream past it; a task keeps k rows a query.  Analogies
are scored likewise: a task holds a block of questions and a block of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors sent with a task: 2,000 of 1,000 dimensions are 16 MB.
BLOCK = 2_000
#: Analogies: a group holds the questions of two blocks of so many pairs, and so many candidates.
PAIRS, CANDIDATES = 128, 4_000
#: Cosines nearer than this are ties.
TIE = 1e-9


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties sharing their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def spearman(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """(by, n, spearman) from average ranks; null below two pairs."""
    x = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(by, a, b)
    r = x.select(by, average_rank(a, [by]).alias("ra"), average_rank(b, [by]).alias("rb"))
    return r.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("spearman"))


def looked_up(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ..) with ``cosine`` of the vectors (id, vec) of both; null where either word has none."""
    x = vectors.select(F.col("id").alias("a"), F.col("vec").alias("__x"))
    y = vectors.select(F.col("id").alias("b"), F.col("vec").alias("__y"))
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    known = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    return both.withColumn("cosine", F.when(known, cosine(F.col("__x"), F.col("__y")))).drop("__x", "__y")


def neighbours(queries: DataFrame, vectors: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(query, neighbour, cosine, place): exact k nearest other vectors; ties by id.

    Queries are numbered into blocks of ``BLOCK`` rows; each block is brought to the driver only to be
    sent along with its pass, so what is sent is bounded whatever the number of queries.
    """
    spark = vectors.sparkSession
    q = queries.select(id_col, vec_col).filter(F.col(vec_col).isNotNull())
    blocks = max(1, -(-q.count() // BLOCK))
    out = None
    for block in range(blocks):
        rows = q.filter(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        mat = np.array([r[1] for r in rows], dtype=np.float64)
        norm = np.linalg.norm(mat, axis=1, keepdims=True)
        mat = np.divide(mat, norm, out=np.zeros_like(mat), where=norm > 0)
        sent = spark.sparkContext.broadcast((ids, mat))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            qi, qm = sent.value
            for pdf in batches:
                pdf = pdf[pdf[vec_col].notna()]
                if not len(pdf):
                    continue
                vi = pdf[id_col].to_numpy(dtype=np.int64)
                v = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
                sim = np.round(qm @ v.T, 9)
                sim[qi[:, None] == vi[None, :]] = -9.0
                order = np.lexsort((np.broadcast_to(vi, sim.shape), -sim), axis=1)[:, :k]
                rows_, cols = np.repeat(np.arange(len(qi)), order.shape[1]), order.ravel()
                keep = sim[rows_, cols] > -9
                yield pd.DataFrame({"query": qi[rows_][keep], "neighbour": vi[cols][keep], "cosine": sim[rows_, cols][keep]})

        part = vectors.select(id_col, vec_col).mapInPandas(run, "query bigint, neighbour bigint, cosine double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query bigint, neighbour bigint, cosine double, place int")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


_COUNTS = pa.schema([("category", pa.string()), *((c, pa.int64()) for c in ("pos", "other", "ahead", "candidates"))])


def _score(top: int):
    """Function of a cogroup: for every question of two blocks of pairs, the candidates of a block that come before the answer."""

    def matrix(vecs: pd.Series) -> np.ndarray:
        return np.stack([np.asarray(v, dtype=np.float64) for v in vecs])

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        pairs, cand = left.to_pandas(), right.to_pandas()
        # First pairs need both vectors, second ones that of a: of b only the place is asked for.
        one = pairs[pairs["first"] & pairs["va"].notna() & pairs["vb"].notna()]
        two = pairs[~pairs["first"] & pairs["va"].notna()]
        if not (len(one) and len(two) and len(cand)):
            return _COUNTS.empty_table()
        cand = cand.sort_values("id")
        ids = cand["id"].to_numpy(dtype=np.int64)
        v = matrix(cand["vec"])
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        at = {x: k for k, x in enumerate(ids.tolist())}
        d, a2 = matrix(one["vb"]) - matrix(one["va"]), matrix(two["va"])
        # An answer that is no candidate is never right.
        asked = (two["vb"].notna() & two["answers"]).to_numpy()
        b2 = np.zeros_like(a2)
        if asked.any():
            b2[asked] = matrix(two["vb"][asked])
        norm = np.linalg.norm(b2, axis=1, keepdims=True)
        b2 = np.divide(b2, norm, out=np.zeros_like(b2), where=norm > 0)
        dv, av = d @ v.T, a2 @ v.T
        a2_id, b2_id, pos2 = two["a"].to_numpy(), two["b"].to_numpy(), two["pos"].to_numpy()
        a2_in = np.isin(a2_id, ids)
        a2_row, b2_row = np.flatnonzero(a2_in), np.flatnonzero(np.isin(b2_id, ids))
        a2_at, b2_at = np.searchsorted(ids, a2_id[a2_row]), np.searchsorted(ids, b2_id[b2_row])
        out = []
        for k, (pos, a, b) in enumerate(zip(one["pos"], one["a"], one["b"], strict=True)):
            target = a2 + d[k]
            scale = TIE * np.linalg.norm(target, axis=1)
            # Cosine with the target, less the answer's, both times the target's length.
            more = av + dv[k] - (target * b2).sum(axis=1)[:, None]
            more[:, [at[x] for x in (a, b) if x in at]] = -np.inf
            more[a2_row, a2_at] = -np.inf
            more[b2_row, b2_at] = -np.inf
            rest = len(ids) - sum(x in at for x in {a, b}) - (a2_in & (a2_id != a) & (a2_id != b))
            ahead = more > scale[:, None]
            near = ~ahead & (more >= -scale[:, None])
            n = ahead.sum(axis=1)
            for r in np.flatnonzero(near.any(axis=1)):
                n[r] += int((near[r] & (ids < b2_id[r])).sum())
            never = ~asked | (b2_id == a) | (b2_id == b) | (b2_id == a2_id)
            n = np.where(never, top, np.minimum(n, top))
            keep = pos2 != pos
            out.append((np.full(keep.sum(), pos), pos2[keep], n[keep], rest[keep]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table([pa.array([key[0].as_py()] * len(columns[0]), pa.string()), *columns], schema=_COUNTS)

    return score


def analogies(pairs: DataFrame, vectors: DataFrame, top: int = 1, pool: DataFrame | None = None) -> DataFrame:
    """(category, n, skipped, accuracy): for pairs (category, pos, a, b) of word ids, all ordered pairs of pairs of a category.

    Target b1 - a1 + a2 must bring b2 among the ``top`` nearest words but a1, b1 and a2; ties by id.
    The nearest are sought among all ``vectors``, or those whose ids are in ``pool`` (id) where that is
    given.  ``pos`` tells the pairs of a category apart.  A question without vectors of a1, b1 and a2,
    or without any candidate, is skipped; one whose b2 is no candidate is wrong.  The accuracy is null
    where all questions are skipped.

    Questions and candidates meet block by block in the tasks, and only counts leave them.
    """
    spark = vectors.sparkSession
    vec = vectors.select("id", "vec").filter("id is not null and vec is not null")
    cand = vec if pool is None else vec.join(pool.select("id").distinct(), "id", "left_semi")
    parts = max(1, -(-cand.count() // CANDIDATES))
    pairs = pairs.select(F.col("category").cast("string").alias("category"), F.col("pos").cast("bigint").alias("pos"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("category is not null")
    sizes = pairs.groupBy("category").agg(F.count(F.lit(1)).alias("m")).withColumn("blocks", F.ceil(F.col("m") / PAIRS).cast("int"))
    known = pairs.join(vec.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a", "left").join(vec.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b", "left")
    if pool is None:
        known = known.withColumn("answers", F.lit(True))
    else:
        known = known.join(pool.select(F.col("id").alias("b"), F.lit(True).alias("answers")).distinct(), "b", "left").withColumn("answers", F.coalesce("answers", F.lit(False)))
    block = known.join(sizes.select("category", "blocks"), "category").withColumn("block", F.pmod(F.xxhash64("pos"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cols = ["pos", "a", "b", "va", "vb", "answers"]
    ones = block.select("category", F.col("block").alias("i"), every.alias("j"), F.lit(True).alias("first"), *cols)
    twos = block.select("category", every.alias("i"), F.col("block").alias("j"), F.lit(False).alias("first"), *cols)
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    left = ones.unionByName(twos).select("*", part)
    groups = sizes.select("category", "blocks", every.alias("i")).select("category", "i", every.alias("j"))
    # Renamed, as both sides come from the same pairs.
    right = cand.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).crossJoin(groups).toDF("id", "vec", "part", "of", "row", "column")
    key, same = ["category", "i", "j", "part"], ["of", "row", "column", "part"]
    # A stated number, as a few MB of vectors are the work of many cores and would be put into one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = left.repartition(tasks, *key).groupBy(*key).cogroup(right.repartition(tasks, *same).groupBy(*same)).applyInArrow(_score(top), "category string, pos bigint, other bigint, ahead bigint, candidates bigint")
    asked = counts.groupBy("category", "pos", "other").agg(F.sum("ahead").alias("ahead"), F.sum("candidates").alias("candidates")).filter("candidates > 0")
    found = asked.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ahead") < top).alias("right"))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return sizes.join(found, "category", "left").select("category", n.alias("n"), (F.col("m") * (F.col("m") - 1) - n).alias("skipped"), (F.col("right") / F.col("n")).alias("accuracy"))
