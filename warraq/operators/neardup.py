"""MinHash-LSH near-duplicate removal: any candidate among the texts kept earlier rejects a text.

128 permutations over character 4-shingles, 9 bands of 13 values (the split
that balances both errors at threshold 0.8).  The result is greedy in order: a
text is compared with kept texts only.  Texts with the same signature share all
bands, and so their fate: only the first of them is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, stored

PERMUTATIONS, BANDS, ROWS = 128, 9, 13
_PRIME = (1 << 61) - 1
_MASK = (1 << 32) - 1


def _permutations(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(seed)
    pairs = [(r.randint(1, _PRIME, dtype=np.uint64), r.randint(0, _PRIME, dtype=np.uint64)) for _ in range(PERMUTATIONS)]
    a, b = np.array(pairs, dtype=np.uint64).T
    return a, b


_A, _B = _permutations()


#: Shingles whose permuted hashes a worker keeps: rows of a table of half a kilobyte each.
MEMO = 100_000


class _Rows(dict):
    """Row numbers of shingles in a table of their hashes under all permutations."""

    def __init__(self) -> None:
        super().__init__()
        self.table = np.empty((1024, PERMUTATIONS), dtype=np.uint32)

    def __missing__(self, shingle: str) -> int:
        row = len(self)
        if row == len(self.table):
            self.table = np.concatenate((self.table, np.empty_like(self.table)))
        h = np.uint64(int.from_bytes(hashlib.sha1(shingle.encode("utf-8", "surrogatepass")).digest()[:4], "little"))
        # Products wrap at 64 bits, as the published scheme's do.
        with np.errstate(over="ignore"):
            self.table[row] = ((h * _A + _B) % np.uint64(_PRIME)) & np.uint64(_MASK)
        self[shingle] = row
        return row


_KNOWN = _Rows()


def minhash(text: str | None) -> list[int] | None:
    """128 minima of a text's shingle hashes; None for null and empty texts."""
    if not text:
        return None
    t = " ".join(text.strip().lower().split())
    if not t:
        return None
    shingles = {t[i : i + 4] for i in range(len(t) - 3)} if len(t) > 4 else {t}
    if len(_KNOWN) + len(shingles) > MEMO:
        # Emptied between texts only, so that a text's rows stay together; one longer text may exceed the bound.
        _KNOWN.clear()
    rows = np.fromiter(map(_KNOWN.__getitem__, shingles), dtype=np.int64, count=len(shingles))
    return _KNOWN.table[rows].min(axis=0).tolist()


def signature(c: Column) -> Column:
    """``minhash`` as a Column."""

    @F.pandas_udf("array<bigint>")
    def signature_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(minhash)

    return signature_udf(c)


def digest(sig: Column) -> Column:
    """First eight values, eight hex digits each."""
    return F.concat_ws("", F.transform(F.slice(sig, 1, 8), lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))))


def _keys(sig_col: str) -> Column:
    return F.array(*[F.xxhash64(F.lit(b), F.slice(sig_col, b * ROWS + 1, ROWS)) for b in range(BANDS)])


def bands(df: DataFrame, id_col: str, sig_col: str) -> DataFrame:
    """(id, band, key): a row a band; the key is a 64-bit hash of its values."""
    return df.filter(F.col(sig_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(_keys(sig_col)).alias("band", "key"))


def keep_first(df: DataFrame, id_col: str, text_col: str, index: DataFrame | None = None) -> DataFrame:
    """(id, kept, dup_of): greedy decisions in id order; ``index`` (band, key) are bands of texts kept by earlier runs.

    Within a band key only the distance to the earliest member matters to the first round, so edges
    are stars, widened round by round to the members still undecided: never all pairs of a bucket.
    """
    sig = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", signature(F.col("text")).alias("sig"))
    # Of a signature only the band keys and a hash are kept: a tenth of it.
    signed = stored(sig.filter("sig is not null").select("id", _keys("sig").alias("keys"), F.xxhash64("sig").alias("h1"), F.xxhash64(F.lit(7), "sig").alias("h2")), "signed")
    own = signed.select("id", "h1", "h2")
    firsts = own.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = stored(own.join(firsts, ["h1", "h2"]).filter(F.col("id") > F.col("first")).select("id", "first"), "copies")
    b = stored(signed.join(copies, "id", "left_anti").select("id", F.posexplode("keys").alias("band", "key")), "bands")
    undecided = b
    if index is not None:
        hit = stored(b.join(index.select("band", "key").distinct(), ["band", "key"], "left_semi").select("id").distinct().withColumn("dup_of", F.lit(None).cast("bigint")), "hit")
        undecided = stored(b.join(hit.select("id"), "id", "left_anti"), "bands")
    else:
        hit = None
    rejected = [hit] if hit is not None else []
    while True:
        # The first undecided member of every bucket it is in is kept; all others there repeat it.
        first = undecided.groupBy("band", "key").agg(F.min("id").alias("first"))
        marked = undecided.join(first, ["band", "key"])
        kept = stored(marked.groupBy("id").agg(F.max("first").alias("m")).filter(F.col("m") == F.col("id")).select("id"), "kept")
        if kept.isEmpty():
            break
        gone = stored(
            marked.join(kept.withColumnRenamed("id", "first"), "first", "left_semi").filter(F.col("id") != F.col("first")).groupBy("id").agg(F.min("first").alias("dup_of")), "gone"
        )
        rejected.append(gone)
        undecided = stored(undecided.join(kept, "id", "left_anti").join(gone.select("id"), "id", "left_anti"), "bands")
    everything = df.select(F.col(id_col).alias("id"))
    out = None
    for r in rejected:
        out = r if out is None else out.unionByName(r)
    if out is None:
        out = copies.select("id", F.col("first").alias("dup_of"))
    else:
        # A copy repeats its first, or what that repeats.
        fate = out.select(F.col("id").alias("first"), "dup_of", F.lit(True).alias("out"))
        out = out.unionByName(copies.join(fate, "first", "left").select("id", F.when(F.col("out"), F.col("dup_of")).otherwise(F.col("first")).alias("dup_of")))
    marks = out.withColumn("gone", F.lit(True))
    return everything.join(marks, "id", "left").select("id", F.col("gone").isNull().alias("kept"), "dup_of")
