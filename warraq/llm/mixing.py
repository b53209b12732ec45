"""Mixing sources to target shares of tokens (problem 9).

Every document gets an exponential key scaled by its quality weight
(Efraimidis-Spirakis: small keys first, heavy documents earlier).  The size of
the mix is the largest for which no source needs more than its allowed
repeats.  A source gives whole epochs first; the rest of its budget is the
prefix in key order that fits it, whatever its documents' sizes, and the gap
before the document that would exceed it is filled by the next that fit.

The prefix sum needs no task that holds a source: keys are binned by source,
bin sums (mergeable) give the bin in which the budget ends, and only that
bin's documents are sorted.

Defined cases: null and empty texts have 0 tokens and are used 0 times; a
source without a row in the targets, or null, isn't mixed; equal keys are
ordered by id; repeated rows are documents of their own; an empty table gives
an empty mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import spread, stored
from .tokens import DEFAULT, token_count

#: Bins of keys a source is cut into; documents of one bin of one source are sorted together.
BINS = 65_536
#: Passes over the keys: the first takes a prefix whatever its documents' sizes; the others fill the gap that the document in
#: which the budget ends leaves, which is less than that document, with the next ones that fit.
PASSES = 3


def quality(text: Column) -> Column:
    """Weight in [0.05, 1]: the share of letters, less for very short texts."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]", ""))
    share = letters / F.greatest(F.length(text), F.lit(1))
    full = F.least(F.lit(1.0), F.length(text) / F.lit(200.0))
    return F.greatest(F.lit(0.05), F.coalesce(share * (0.5 + 0.5 * full), F.lit(0.05)))


def exponential_key(id_col: Column, weight: Column, seed: int) -> Column:
    """-ln(u)/w with u in (0, 1) from a hash of the id, so that retries and reruns agree."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / weight


@dataclass
class Mix:
    """``documents``: (id, source, tokens, copies), copies > 0; ``shares``: one row a target source."""

    documents: DataFrame
    shares: DataFrame


def _prefix(wanted: DataFrame, state: list[tuple], filling: bool, last: bool) -> tuple[DataFrame, DataFrame]:
    """(documents of the prefix that fits each source's budget, per source the first that didn't and what was taken).

    ``state`` has (source, budget, key, id): documents after that key; ``filling``: none larger than the budget.
    """
    spark = wanted.sparkSession
    kind = wanted.schema["id"].dataType.simpleString()
    # As many rows as target sources.
    now = F.broadcast(spark.createDataFrame(state, f"source string, rest double, key0 double, id0 {kind}"))
    later = (F.col("key") > F.col("key0")) | ((F.col("key") == F.col("key0")) & F.coalesce(F.col("id") > F.col("id0"), F.lit(True)))
    # Monotone in the key, and near even over documents of every weight.
    bin_no = F.floor(F.col("key") / (F.lit(1.0) + F.col("key")) * BINS).cast("int")
    fit = F.col("tokens") <= F.col("rest") if filling else F.lit(True)
    binned = wanted.join(now, "source").filter(later & fit).withColumn("bin", bin_no)
    sums = binned.groupBy("source", "bin", "rest").agg(F.sum("tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sums.withColumn("before", before).filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest")))
    edge = spark.createDataFrame(edge.select("source", F.col("bin").alias("edge"), "before").collect(), "source string, edge int, before bigint")
    marked = binned.join(F.broadcast(edge), "source", "left")
    order = Window.partitionBy("source", "bin").orderBy("key", "id")
    ranked = marked.filter(F.col("bin") == F.col("edge")).withColumn(
        "upto", F.col("before") + F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    under = F.col("rest") - (F.col("upto") - F.col("tokens"))
    fits = F.col("upto") <= F.col("rest")
    if last:
        # The document that crosses the budget is taken if that comes closer.
        fits = fits | ((under >= 0) & (F.col("upto") - F.col("rest") < under))
    taken = marked.filter(F.col("edge").isNull() | (F.col("bin") < F.col("edge"))).select("id", "source", "tokens").unionByName(
        ranked.filter(fits).select("id", "source", "tokens")
    )
    first = F.min_by(F.struct("key", "id", (F.col("upto") - F.col("tokens")).alias("took")), F.struct("key", "id"))
    cross = ranked.filter(F.col("upto") > F.col("rest")).groupBy("source").agg(first.alias("x")).select("source", "x.key", "x.id", "x.took")
    return taken, cross


def mix(
    df: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    tokenizer: str = DEFAULT,
    seed: int = 17,
    total_tokens: int | None = None,
    folder: str | None = None,
) -> Mix:
    """Combine the sources; ``total_tokens`` None means as large as the repeats allow.

    ``targets`` has a row (source, target_share, max_repeats) a source; its rows are read to the
    driver, being as many as there are sources to configure.
    """
    slim = spread(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")))
    sized = slim.select("id", "source", token_count(F.col("text"), tokenizer, folder).alias("tokens"), quality(F.col("text")).alias("weight"))
    # Used for the totals, the bin sums and the selection: counted once.
    keyed = stored(sized.select("id", "source", "tokens", exponential_key(F.col("id"), F.col("weight"), seed).alias("key")), "keyed")
    goals = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None}
    wanted = keyed.filter(F.col("source").isin(list(goals)) & (F.col("tokens") > 0))
    have = {r["source"]: (r["t"], r["n"]) for r in wanted.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    limits = [goals[s][1] * t / goals[s][0] for s, (t, _) in have.items() if goals[s][0] > 0]
    # A target without any token can't be met; the others keep their proportions.
    size = min(limits, default=0.0)
    if total_tokens is not None:
        size = min(size, float(total_tokens))
    epochs, rest = {}, {}
    for s, (t, _) in have.items():
        budget = goals[s][0] * size
        epochs[s] = min(int(budget // t), goals[s][1])
        rest[s] = budget - epochs[s] * t if epochs[s] < goals[s][1] else 0.0
    spark = df.sparkSession
    plan = spark.createDataFrame([(s, int(epochs[s]), float(rest[s])) for s in have] or [("", 0, 0.0)], "source string, epochs int, rest double")

    # Pass by pass: the prefix that fits, then past the document that didn't, with those that still fit.
    parts, at = [], {s: (0.0, None) for s in have}
    for no in range(PASSES):
        state = [(s, float(rest[s]), at[s][0], at[s][1]) for s in have if rest[s] >= 1 and at[s] is not None]
        if not state:
            break
        taken, cross = _prefix(wanted, state, filling=no > 0, last=no == PASSES - 1)
        parts.append(taken)
        ends = {r["source"]: r for r in cross.collect()}
        for s, *_ in state:
            if s in ends:
                rest[s] -= ends[s]["took"]
                at[s] = (ends[s]["key"], ends[s]["id"])
            else:
                rest[s] = 0.0
    extra = parts[0] if parts else wanted.select("id", "source", "tokens").limit(0)
    for part in parts[1:]:
        extra = extra.unionByName(part)
    whole = wanted.join(F.broadcast(plan), "source").filter("epochs > 0").select("id", "source", "tokens", F.col("epochs").alias("copies"))
    documents = whole.unionByName(extra.withColumn("copies", F.lit(1))).groupBy("id", "source", "tokens").agg(F.sum("copies").cast("int").alias("copies"))
    reached = documents.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    known = spark.createDataFrame(
        [(s, share, reps, int(have.get(s, (0, 0))[0]), int(have.get(s, (0, 0))[1])) for s, (share, reps) in sorted(goals.items())] or [("", 0.0, 0, 0, 0)],
        "source string, target_share double, max_repeats int, source_tokens bigint, source_documents bigint",
    ).filter(F.col("source") != "")
    zero = F.lit(0).cast("bigint")
    everything = Window.partitionBy()
    shares = (
        known.join(reached, "source", "left")
        .select("source", "target_share", "max_repeats", "source_tokens", "source_documents", F.coalesce("mixed_tokens", zero).alias("mixed_tokens"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
        .withColumn("reached_share", F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(everything), zero))
    )
    return Mix(documents.withColumnRenamed("id", id_col).withColumnRenamed("source", source_col), shares)


def largest_size(tokens: dict[str, int], goals: dict[str, tuple[float, int]]) -> float:
    """Largest total for which every source stays within its repeats (for tests and planning)."""
    return min((goals[s][1] * t / goals[s][0] for s, t in tokens.items() if goals.get(s, (0, 0))[0] > 0 and t), default=math.nan)
