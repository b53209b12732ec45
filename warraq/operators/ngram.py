"""N-gram counts, back-off completion and modified Kneser-Ney as DataFrames.

Contexts with null or empty token arrays contribute only their padding.
Nothing is gathered by context: every step is a grouped aggregate or a join on
the n-gram, and probabilities are attached by joins, longest match first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BOS, EOS = "<s>", "</s>"


def joined_ngrams(tokens: Column, n: int) -> Column:
    """Blank-joined n-grams of a token array (the array is read n times, not once an element)."""
    out = tokens
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, k + 1, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.filter(out, lambda x: x.isNotNull())


def counts_by_source(df: DataFrame, arr: str, name: str) -> DataFrame:
    """Counts of array items of rows (source, id, array) by two sources, and the number of rows that hold them.

    Sorted, an item's repeats in a row are neighbours, so the first of each is known in the row: one shuffle, of the items'
    partial counts, combined map-side; a frequent item costs a row a task.
    """
    own = df.select("source", F.array_sort(arr).alias("s"))
    marked = F.transform("s", lambda x, i: F.struct(x.alias("t"), ((i == 0) | (F.try_element_at(F.col("s"), F.greatest(i, F.lit(1))) != x)).alias("first")))
    items = own.select("source", F.explode(marked).alias("x")).select("source", F.col("x.t").alias(name), F.col("x.first").alias("first"))

    def of(source: str) -> Column:
        return F.count_if(F.coalesce(F.col("source") == source, F.lit(False)))

    return items.groupBy(name).agg(F.count(F.lit(1)).alias("total_count"), of("youtube").alias("youtube_count"), of("djelfa").alias("djelfa_count"), F.count_if("first").alias("doc_count"))


def trigrams(df: DataFrame, tokens: Column) -> DataFrame:
    """(w1, w2, w3, n) with two start markers and one end marker."""
    w = F.concat(F.array(F.lit(BOS), F.lit(BOS)), tokens, F.array(F.lit(EOS)))
    x = df.select(w.alias("w")).filter("w is not null")
    g = x.select(F.explode(F.transform(F.sequence(F.lit(3), F.size("w")), lambda i: F.struct(F.element_at("w", i - 2).alias("w1"), F.element_at("w", i - 1).alias("w2"), F.element_at("w", i).alias("w3")))).alias("g"))
    return g.groupBy("g.w1", "g.w2", "g.w3").agg(F.count(F.lit(1)).alias("n"))


def next_tokens(tri: DataFrame, prefixes: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(prefix_id, token, n, p); ``prefixes`` are few, given by the user, and broadcast."""
    p = F.broadcast(prefixes)
    three = tri.join(p, ["w1", "w2"]).select("prefix_id", F.col("w3").alias("token"), "n")
    bi = tri.join(p.select("prefix_id", "w2"), "w2").groupBy("prefix_id", F.col("w3").alias("token")).agg(F.sum("n").alias("n"))
    two = bi.join(F.broadcast(three.select("prefix_id").distinct()), "prefix_id", "left_anti")
    rest = prefixes.select("prefix_id").join(three.select("prefix_id").distinct(), "prefix_id", "left_anti").join(bi.select("prefix_id").distinct(), "prefix_id", "left_anti")
    uni = tri.filter(F.col("w3") != EOS).groupBy(F.col("w3").alias("token")).agg(F.sum("n").alias("n"))
    one = uni.join(F.broadcast(rest)).select("prefix_id", "token", "n")
    u = three.unionByName(two).unionByName(one).withColumn("weight", F.pow("n", F.lit(1 / temperature)))
    total = u.groupBy("prefix_id").agg(F.sum("weight").alias("total"))
    return u.join(F.broadcast(total), "prefix_id").select("prefix_id", "token", F.col("n").cast("bigint").alias("n"), F.round(F.col("weight") / F.col("total"), 9).alias("p"))


def complete(tri: DataFrame, prefixes: DataFrame, most: int) -> DataFrame:
    """(prefix_id, step, token): the likeliest next token again and again, until the end marker.

    Best continuations are aggregated once (a row a context); the loop only touches the few prefixes.
    """
    best3 = stored(tri.groupBy("w1", "w2").agg(F.max_by("w3", F.struct("n", "w3")).alias("token")), "best3")
    best2 = stored(tri.groupBy("w2", "w3").agg(F.sum("n").alias("n")).groupBy("w2").agg(F.max_by("w3", F.struct("n", "w3")).alias("token")), "best2")
    best1 = tri.filter(F.col("w3") != EOS).groupBy("w3").agg(F.sum("n").alias("n")).agg(F.max_by("w3", F.struct("n", "w3"))).first()[0]
    out = []
    now = [(r["prefix_id"], r["w1"], r["w2"]) for r in prefixes.collect()]
    for step in range(1, most + 1):
        if not now:
            break
        p = tri.sparkSession.createDataFrame(now, "prefix_id int, w1 string, w2 string")
        found = p.join(best3, ["w1", "w2"], "left")
        found = found.withColumnRenamed("token", "t3").join(best2, "w2", "left").select("prefix_id", "w2", F.coalesce("t3", "token", F.lit(best1)).alias("token"))
        rows = found.collect()
        out += [(r["prefix_id"], step, r["token"]) for r in rows]
        now = [(r["prefix_id"], r["w2"], r["token"]) for r in rows if r["token"] not in (EOS, None)]
    return tri.sparkSession.createDataFrame(out, "prefix_id int, step int, token string")


# --- modified Kneser-Ney ----------------------------------------------------


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts for counts of one, two, three and more, from counts of counts (Chen and Goodman)."""
    c = {r["n"]: r["k"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    n1, n2, n3, n4 = (c.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5  # fallback for small tables
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(x if x > 0 else f for x, f in zip(d, (0.5, 1.0, 1.5)))  # type: ignore[return-value]


def _discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def kneser_ney(df: DataFrame, arr: str) -> dict[str, DataFrame]:
    """Interpolated trigram model as tables: ``p3`` (w1,w2,w3,p), ``p2`` (w2,w3,p), ``p1`` (w3,p), back-off weights ``b3``, ``b2`` and the unknown's ``p0``."""
    tri = stored(trigrams(df, F.col(arr)), "tri")
    # Lower orders use continuation counts: in how many contexts an n-gram appears.  What begins a sentence has one
    # context only, so its own counts are kept.
    bi = stored(tri.groupBy("w2", "w3").agg(F.when(F.col("w2") == BOS, F.sum("n")).otherwise(F.count(F.lit(1))).alias("n")), "bi")
    uni = stored(bi.groupBy("w3").agg(F.count(F.lit(1)).alias("n")), "uni")
    d3, d2, d1 = _discounts(tri), _discounts(bi), _discounts(uni)

    def level(counts: DataFrame, ctx: list[str], d: tuple[float, float, float]) -> DataFrame:
        left = F.sum(_discount(F.col("n"), d))
        return counts.groupBy(*ctx).agg(F.sum("n").alias("total"), left.alias("left"))

    t1 = uni.agg(F.sum("n").alias("total"), F.sum(_discount(F.col("n"), d1)).alias("left"), F.count(F.lit(1)).alias("types")).first()
    total1, left1, types = (t1["total"] or 1), (t1["left"] or 0.0), (t1["types"] or 0) + 1
    p0 = left1 / total1 / types
    p1 = stored(uni.select("w3", ((F.col("n") - _discount(F.col("n"), d1)) / F.lit(float(total1)) + F.lit(p0)).alias("p")), "p1")
    c2 = level(bi, ["w2"], d2)
    p2 = bi.join(c2, "w2").join(p1.withColumnRenamed("p", "q"), "w3").select("w2", "w3", ((F.col("n") - _discount(F.col("n"), d2)) / F.col("total") + F.col("left") / F.col("total") * F.col("q")).alias("p"))
    p2 = stored(p2, "p2")
    b2 = stored(c2.select("w2", (F.col("left") / F.col("total")).alias("b")), "b2")
    c3 = level(tri, ["w1", "w2"], d3)
    p3 = tri.join(c3, ["w1", "w2"]).join(p2.withColumnRenamed("p", "q"), ["w2", "w3"]).select("w1", "w2", "w3", ((F.col("n") - _discount(F.col("n"), d3)) / F.col("total") + F.col("left") / F.col("total") * F.col("q")).alias("p"))
    return {"p3": stored(p3, "p3"), "p2": p2, "p1": p1, "b3": stored(c3.select("w1", "w2", (F.col("left") / F.col("total")).alias("b")), "b3"), "b2": b2, "p0": df.sparkSession.createDataFrame([(float(p0),)], "p double")}


def scores(model: dict[str, DataFrame], df: DataFrame, id_col: str, arr: str) -> DataFrame:
    """(id, log10p, oov) for each distinct n-gram occurrence group: trigram, else back-off times bigram, else unigram."""
    w = F.concat(F.array(F.lit(BOS), F.lit(BOS)), F.col(arr), F.array(F.lit(EOS)))
    x = df.select(id_col, w.alias("w")).filter("w is not null")
    g = x.select(id_col, F.explode(F.transform(F.sequence(F.lit(3), F.size("w")), lambda i: F.struct(F.element_at("w", i - 2).alias("w1"), F.element_at("w", i - 1).alias("w2"), F.element_at("w", i).alias("w3")))).alias("g")).select(id_col, "g.*")
    # Distinct n-grams are looked up once, however often they occur.
    types = g.groupBy("w1", "w2", "w3").agg(F.count(F.lit(1)).alias("k"))
    p0 = model["p0"].first()["p"]
    look = (
        types.join(model["p3"], ["w1", "w2", "w3"], "left")
        .join(model["p2"].withColumnRenamed("p", "p2"), ["w2", "w3"], "left")
        .join(model["p1"].withColumnRenamed("p", "p1"), ["w3"], "left")
        .join(model["b3"].withColumnRenamed("b", "b3"), ["w1", "w2"], "left")
        .join(model["b2"].withColumnRenamed("b", "b2"), ["w2"], "left")
    )
    one = F.lit(1.0)
    p = F.coalesce("p", F.coalesce("b3", one) * F.coalesce("p2", F.coalesce("b2", one) * F.coalesce("p1", F.lit(float(p0)))))
    look = look.select("w1", "w2", "w3", F.log10(p).alias("log10p"), F.col("p1").isNull().alias("oov"))
    return g.join(look, ["w1", "w2", "w3"]).groupBy(id_col).agg(F.sum("log10p").alias("log10p"), F.count_if("oov").alias("oov"), F.count(F.lit(1)).alias("tokens"))


def perplexity(model: dict[str, DataFrame], df: DataFrame, id_col: str, arr: str, by: str) -> DataFrame:
    """Per group: documents, words, perplexity per word 10^(-sum/words), OOV token rate."""
    s = scores(model, df, id_col, arr)
    words = df.select(id_col, by, F.size(arr).alias("words"))
    return (
        words.join(s, id_col)
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("docs"),
            F.sum("words").alias("words"),
            F.round(F.pow(F.lit(10.0), -F.sum("log10p") / F.nullif(F.sum("words"), F.lit(0))), 4).alias("perplexity_per_word"),
            F.round(F.sum("oov") / F.sum("tokens"), 6).alias("oov_token_rate"),
        )
    )
