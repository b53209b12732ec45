"""Near-duplicates of new batches against all accepted history (problem 2).

A prefix-tree hash forest.  Each distinct text has one signature of min-hash
bytes; its label in the i-th of ``TREES`` trees is the signature read from the
i-th place on, so the trees are sorted permutations of one signature, and texts
that agree in the first bytes of a label lie next to each other in that tree.

The forest is a folder: runs of entries, bucketed by the head of the label and
sorted by the whole, the normal texts of the accepted rows, and a manifest that
names the live runs.  ``build`` makes it once from the history, ``admit`` looks
a delivery up and appends its accepted texts as a run, ``merge`` makes one run
of the small ones, ``Forest.open`` finds it again from another application.

A look-up is a search for the range of labels with the same prefix.  Its depth
starts at the whole label and is widened until a pair at the threshold meets
in some tree with the wanted probability; a target that even the head of a
label can't reach is an error.  The history's entries aren't moved: look-ups
are sent to its buckets, and those of a small delivery read only the buckets
they fall in.  Pairs whose set sizes exclude the threshold are left out, and
those whose signatures exclude it for all but about two pairs in a million at
the threshold (``AGREE``, ``BOTH``; ``exact`` verifies them too).  Unlike long
texts of one language meet in number like the square of the texts, so entries of
long texts carry their signature, and such pairs end where they meet.  Every other
pair is verified by its texts' exact similarity; the raw history is never read.

What is decided (arrival order is ``ord``): rows of the history are accepted;
a new row is rejected if it repeats a row accepted before it, and ``kept`` is
the first such row.  Exact copies are one text.  Buckets of more than ``WIDE``
texts aren't paired out: all are compared with the bucket's first text, and
those that repeat it, once it is known to be accepted, leave every bucket; so
a group of near-copies of any size costs its size.  What remains is paired,
whatever it is: nothing is capped.

Defined cases: null, empty and short texts (fewer than ``least`` characters
after cleaning) are never compared; rows with a null id or batch neither; ids
and batches out of range are an error; a row delivered again is a row of its
own; an empty delivery rejects nothing; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import clean_comment_texts, clean_post_texts
from ..operators.common import drop_path, release, scratch, spread, stored

TREES = 16
#: Places of the signature between the starts of two labels; prefixes up to it are independent between trees.
STEP = 5
FUNCTIONS = TREES * STEP
#: Bytes of a label, and those of its head, by which entries are bucketed and below which nothing is looked up.
LABEL, HEAD = 7, 3
SHINGLE = 4
THRESHOLD = 0.8
RECALL = 0.995
LEAST = 60
#: Functions that must agree: of 80, at the threshold 64 do on average and fewer than 46 for one pair in 800,000.
AGREE = 46
#: Least shingles of a long text, of which the ``BOTTOM`` smallest hashes are kept too: for two long texts, the functions that
#: agree and the smallest hashes of both that either has are 144 trials; at the threshold 115 hit, fewer than 91 for one pair in a million.
#: Entries of long texts carry the four bits of every function.
LONG, BOTTOM, BOTH = 256, 64, 91
#: Texts of a range that are paired out; wider ranges are thinned by their first texts before.
WIDE = 64
#: Wide ranges of the history are found by one text in so many: this only decides which ranges are thinned.
PROBE = 8
#: Ids of candidates up to this many are broadcast (3 MB), more are joined by shuffle.
BROADCAST_IDS = 200_000
#: Shingle sets of texts that a worker keeps while it verifies, in shingles.
MEMO = 4_000_000
#: Nearness to the threshold within which hashed sets don't decide.
MARGIN = 0.01
#: Look-ups up to this many are told to the scan, so that it reads only their buckets.
FEW = 2_000
#: Live runs from which ``merge`` is worth while, and how much larger than the rest a run must be to be left alone by it.
RUNS, TIER = 3, 1.2

_WS = re.compile(r"\s+")
_ODD = np.random.default_rng(20240229).integers(1, 1 << 31, size=(2, FUNCTIONS), dtype=np.uint32)
_MUL, _XOR = _ODD[0] * np.uint32(2) + np.uint32(1), _ODD[1]
_ENTRY, _LONG = "route bigint, label bigint, ord bigint, n int", "fours array<bigint>"


def reached(depth: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    """Probability that a pair at the threshold meets in some tree at a prefix depth."""
    return 1 - (1 - threshold**depth) ** trees


def depth_for(recall: float = RECALL, threshold: float = THRESHOLD, trees: int = TREES) -> int:
    """Prefixes are widened, from the whole label on, until the recall target is reached."""
    k = LABEL
    while reached(k, threshold, trees) < recall:
        k -= 1
        if k < HEAD:
            raise ValueError(f"a recall of {recall} at {threshold} needs prefixes shorter than {HEAD} bytes, or more than {trees} trees")
    return k


def normal(texts: list[str | None], post: list[bool], least: int = LEAST) -> list[str | None]:
    """Cleaned, lower-cased, white space single; None for texts that are never compared."""
    a = [k for k, p in enumerate(post) if p]
    b = [k for k, p in enumerate(post) if not p]
    out: list[str | None] = [None] * len(texts)
    for where, clean in ((a, clean_post_texts), (b, clean_comment_texts)):
        for k, t in zip(where, clean([texts[k] for k in where])):
            if t is not None and len(t) >= least:
                out[k] = _WS.sub(" ", t.lower().strip())
    return out


def shingles(text: str) -> frozenset[str]:
    """Set of character shingles; the whole text if it isn't longer."""
    return frozenset(text[i : i + SHINGLE] for i in range(len(text) - SHINGLE + 1)) if len(text) > SHINGLE else frozenset((text,) if text else ())


def hashed(text: str) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles of a text longer than a shingle."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    m = len(cp) - SHINGLE + 1
    h = np.zeros(m, dtype=np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + cp[k : m + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = np.sort(h >> np.uint64(1))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, labels [texts, TREES], four bits of every function [texts, 5], smallest hashes [long texts, BOTTOM]) of texts of at least a shingle."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum(lens)
    m = len(cp) - SHINGLE + 1
    h = np.zeros(m, dtype=np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + cp[k : m + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), lens)[:m]
    inside = np.arange(m) < (ends[doc.astype(np.int64)] - SHINGLE + 1)
    # Sorted by text and hash, equal shingles of a text are neighbours.
    key = np.sort((doc[inside] << np.uint64(40)) | (h[inside] >> np.uint64(24)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    owner = (key >> np.uint64(40)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    x = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    least = np.empty((FUNCTIONS, len(texts)), dtype=np.uint32)
    buf = np.empty_like(x)
    for k in range(FUNCTIONS):
        np.bitwise_xor(x, _XOR[k], out=buf)
        np.multiply(buf, _MUL[k], out=buf)
        np.minimum.reduceat(buf, starts, out=least[k])
    mixed = least * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA6B)
    byte = (mixed >> np.uint32(24)).astype(np.int64)
    labels = np.zeros((len(texts), TREES), dtype=np.int64)
    for t in range(TREES):
        for j in range(LABEL):
            labels[:, t] = (labels[:, t] << 8) | byte[(t * STEP + j) % FUNCTIONS]
    fours = (mixed >> np.uint32(20) & np.uint32(15)).astype(np.uint64)
    packed = np.zeros((len(texts), FUNCTIONS // 16), dtype=np.uint64)
    for k, four in enumerate(fours):
        packed[:, k // 16] |= four << np.uint64(4 * (k % 16))
    # Sorted as they are, a text's smallest hashes come first.
    bottom = key[starts[sizes >= LONG][:, None] + np.arange(BOTTOM)] & np.uint64((1 << 40) - 1)
    return sizes, labels, packed.view(np.int64), (bottom >> np.uint64(9)).astype(np.int32)


_SIGNED = "ord bigint, h1 bigint, h2 bigint, n int, labels array<bigint>, fours array<bigint>, bottom array<int>, text string"


def sign(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """Signatures and normal texts of the rows (ord, post, text) that are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = normal(b.column(2).to_pylist(), b.column(1).to_pylist(), least)
            has = [k for k, t in enumerate(texts) if t is not None]
            # Small groups, so that the arrays stay in the cache and long texts within memory.
            at = 0
            while at < len(has):
                part, size = [], 0
                while at < len(has) and len(part) < 4096 and size < 400_000:
                    part.append(has[at])
                    size += len(texts[has[at]])
                    at += 1
                own = [texts[k] for k in part]
                n, labels, fours, bottom = signatures(own)
                raw = [t.encode("utf-8", "surrogatepass") for t in own]
                digest = np.array([divmod(xxhash.xxh3_128_intdigest(t), 1 << 64) for t in raw], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(part)),
                        pa.array(np.ascontiguousarray(digest[:, 0])),
                        pa.array(np.ascontiguousarray(digest[:, 1])),
                        pa.array(n.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, labels.size + 1, TREES, dtype=np.int32)), pa.array(labels.ravel())),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, fours.size + 1, fours.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(fours).ravel())),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(n >= LONG, BOTTOM, 0)))).astype(np.int32)), pa.array(bottom.ravel())),
                        pa.array(own, pa.string()),
                    ],
                    names=["ord", "h1", "h2", "n", "labels", "fours", "bottom", "text"],
                )

    return spread(rows.select("ord", "post", "text").filter("ord is not null and text is not null")).mapInArrow(run, _SIGNED)


_IDS, _BATCHES = 1 << 44, 1 << 12


def order_of(space: int, batch: Column, row: Column) -> Column:
    """Arrival order of a row as one number: name space, batch, id; an id of 2**44 or more, a batch of 2**12 or more, or a negative one is an error."""
    bits = F.shiftleft(F.lit(space).cast("bigint"), 56).bitwiseOR(F.shiftleft(batch.cast("bigint"), 44)).bitwiseOR(row.cast("bigint"))
    inside = row.between(0, _IDS - 1) & batch.between(0, _BATCHES - 1)
    # Null ids and batches make the condition null, and the order too.
    return F.when(inside, bits).when(~inside, F.raise_error(F.concat(F.lit("id or batch out of range: "), row.cast("string"), F.lit(", "), batch.cast("string"))).cast("bigint"))


def row_of(order: Column) -> Column:
    """Id of a row by its order."""
    return order.bitwiseAND(F.lit(_IDS - 1))


def batch_of(order: Column) -> Column:
    """Batch of a row by its order."""
    return F.shiftrightunsigned(order, 44).bitwiseAND(F.lit(_BATCHES - 1)).cast("int")


def space_of(order: Column) -> Column:
    """Name space of a row by its order."""
    return F.shiftright(order, 56).cast("int")


def copies_of(signed: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(ord, first): the rows whose text occurs before in the same name space, with the first such row."""
    own = signed.select("ord", "h1", "h2", space_of(F.col("ord")).alias("space"))
    first = own.groupBy("space", "h1", "h2").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    first = step(first)
    return own.join(_small(first, first.count()), ["space", "h1", "h2"]).filter(F.col("ord") > F.col("first")).select("ord", "first")


def _entries(texts: DataFrame) -> DataFrame:
    """Forest entries (route, label, ord, n, fours of long texts) of distinct texts; the route is name space, tree and head of the label."""
    e = texts.select("ord", "n", F.when(F.col("n") >= LONG, F.col("fours")).alias("fours"), space_of(F.col("ord")).alias("space"), F.posexplode("labels").alias("tree", "label"))
    tree = (F.col("space") * TREES + F.col("tree")).cast("bigint")
    return e.select(F.shiftleft(tree, 8 * HEAD).bitwiseOR(F.shiftrightunsigned("label", 8 * (LABEL - HEAD))).alias("route"), "label", "ord", "n", "fours")


def _low(label: Column, depth: int) -> Column:
    """First label of the range that shares a prefix."""
    rest = 8 * (LABEL - depth)
    return F.shiftleft(F.shiftrightunsigned(label, rest), rest)


def _ranges(asked: DataFrame) -> DataFrame:
    """(route, low, size, leader) of the ranges that look-ups fall in."""
    return asked.groupBy("route", "low").agg(F.count(F.lit(1)).alias("size"), F.min("ord").alias("leader"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_IDS else df


# --- the persisted forest -----------------------------------------------------


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@dataclass
class Forest:
    """A persisted forest: entries of live runs, texts, and a manifest, under one folder."""

    spark: SparkSession
    path: str
    buckets: int
    runs: dict[int, int] = field(default_factory=dict)
    stores: list[int] = field(default_factory=list)
    gone: list[int] = field(default_factory=list)
    version: int = 0

    @classmethod
    def create(cls, spark: SparkSession, buckets: int | None = None, path: str | None = None) -> Forest:
        """An empty forest, in the shared folder unless a path is given."""
        f = cls(spark, path or scratch(spark, "forest"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        f._define()
        f._save()
        return f

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Forest:
        """The forest that an earlier application left under a path."""
        fs, p = _fs(spark, path)
        versions = sorted(int(s.getPath().getName()[9:-5]) for s in fs.listStatus(p) if re.fullmatch(r"manifest-\d+\.json", s.getPath().getName()))
        if not versions:
            raise ValueError(f"no forest under {path}")
        kept = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest-{versions[-1]}.json").collect()))
        if (kept["trees"], kept["step"], kept["label"], kept["head"], kept["shingle"]) != (TREES, STEP, LABEL, HEAD, SHINGLE):
            raise ValueError("the forest was made with other constants")
        f = cls(spark, path, kept["buckets"], {int(k): v for k, v in kept["runs"].items()}, kept["stores"], kept["gone"], versions[-1])
        f._define()
        return f

    def _define(self) -> None:
        # The bucketing is known to a table only; its definition is made anew for every application, the files stay.
        self.name = f"forest_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {self.name} ({_ENTRY}, {_LONG}, run int) USING parquet OPTIONS (path '{self.path}/entries') PARTITIONED BY (run) CLUSTERED BY (route) SORTED BY (route, label) INTO {self.buckets} BUCKETS"
        )
        if self.runs:
            self.spark.catalog.recoverPartitions(self.name)

    def _save(self) -> None:
        """A new version of the manifest: what it doesn't name is not part of the forest."""
        self.version += 1
        kept = {"trees": TREES, "step": STEP, "label": LABEL, "head": HEAD, "shingle": SHINGLE, "buckets": self.buckets, "runs": self.runs, "stores": self.stores, "gone": self.gone}
        fs, target = _fs(self.spark, f"{self.path}/manifest-{self.version}.json")
        draft = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(kept).encode()))
        out.close()
        fs.rename(draft, target)

    def _write(self, entries: DataFrame, run: int) -> int:
        """Write a run, one sorted file a bucket; the number of its entries."""
        # The route has the head of the label: what is sent is the rest of it, beside the size in one number.
        rest = 8 * (LABEL - HEAD)
        sent = entries.select("route", F.shiftleft("label", 64 - rest).bitwiseOR(F.col("n").cast("bigint")).alias("rest"), "ord", "fours").repartition(self.buckets, "route")
        label = F.shiftleft(F.col("route").bitwiseAND(F.lit((1 << 8 * HEAD) - 1)), rest).bitwiseOR(F.shiftrightunsigned("rest", 64 - rest))
        by_bucket = sent.select("route", label.alias("label"), "ord", F.col("rest").bitwiseAND(F.lit((1 << 64 - rest) - 1)).cast("int").alias("n"), "fours", F.lit(run).alias("run"))
        by_bucket.write.format("parquet").mode("append").partitionBy("run").bucketBy(self.buckets, "route").sortBy("route", "label").option("path", f"{self.path}/entries").option("compression", "zstd").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        own = self.spark.table(self.name).filter(F.col("run") == run)
        # Bucketed by route, the ranges are counted where they lie.
        wide = _ranges(lookups(own.filter(F.pmod(F.xxhash64("ord"), F.lit(PROBE)) == 0), depth_for())).filter(F.col("size") > WIDE // PROBE)
        wide.write.mode("overwrite").parquet(f"{self.path}/wide/run={run}")
        return own.count()

    def new_store(self) -> tuple[int, str]:
        """Number and path for the signed texts of a delivery; they belong to the forest once the delivery is appended."""
        n = max([-1, *self.stores]) + 1
        path = f"{self.path}/texts/{n}"
        drop_path(self.spark, path)
        return n, path

    def pending(self, entries: DataFrame) -> tuple[int, int]:
        """Write a delivery's entries as a run that isn't live yet; its number and size."""
        run = max([-1, *self.runs, *self.gone]) + 1
        drop_path(self.spark, f"{self.path}/entries/run={run}")
        return run, self._write(entries, run)

    def commit(self, run: int, n: int, store: int, rejected: DataFrame | None = None) -> Forest:
        """Make a pending run live, but for its rejected texts (ord); these leave the entries at the next merge."""
        if rejected is not None:
            rejected.select("ord").write.mode("overwrite").parquet(f"{self.path}/gone/{run}")
            self.gone.append(run)
        self.runs[run] = n
        self.stores.append(store)
        self._save()
        return self

    def rejected(self) -> DataFrame | None:
        """(ord) of the texts of live runs that aren't accepted."""
        return self.spark.read.schema("ord bigint").parquet(*[f"{self.path}/gone/{r}" for r in self.gone]) if self.gone else None

    def entries(self) -> DataFrame:
        """Entries of all live runs, those of rejected texts among them."""
        if not self.runs:
            return self.spark.createDataFrame([], f"{_ENTRY}, {_LONG}, run int")
        return self.spark.table(self.name).filter(F.col("run").isin(list(self.runs) or [-1]))

    def texts(self) -> DataFrame:
        """(ord, text, fours, bottom) of the texts of all deliveries."""
        kept = "ord bigint, text string, fours array<bigint>, bottom array<int>"
        return self.spark.read.schema(kept).parquet(*[f"{self.path}/texts/{n}" for n in self.stores]) if self.stores else self.spark.createDataFrame([], kept)

    def wide_ranges(self, depth: int) -> DataFrame | None:
        """Ranges that hold many texts, with an early one; None if there are none."""
        if depth != depth_for() or not self.runs:
            return None
        wide = self.spark.read.schema("route bigint, low bigint, size bigint, leader bigint").parquet(*[f"{self.path}/wide/run={r}" for r in self.runs])
        return None if wide.isEmpty() else wide.groupBy("route", "low").agg(F.min("leader").alias("leader"))

    def merge(self) -> Forest:
        """One sorted run instead of the small ones; a run ``TIER`` times as large as all smaller ones together is left alone."""
        small, total = [], 0
        for run, n in sorted(self.runs.items(), key=lambda x: x[1]):
            if small and len(small) > 1 and n >= TIER * total:
                break
            small.append(run)
            total += n
        if len(small) < 2:
            return self
        new = max([*self.runs, *self.gone]) + 1
        own, left = self.spark.table(self.name).filter(F.col("run").isin(small)), self.rejected()
        n = self._write(own if left is None else own.join(_small(left, left.count()), "ord", "left_anti"), new)
        done = [r for r in self.gone if r in small]
        self.runs = {r: k for r, k in self.runs.items() if r not in small} | {new: n}
        self.gone = [r for r in self.gone if r not in small]
        self._save()
        for r in done:
            drop_path(self.spark, f"{self.path}/gone/{r}")
        for r in small:
            drop_path(self.spark, f"{self.path}/entries/run={r}")
            drop_path(self.spark, f"{self.path}/wide/run={r}")
        self.spark.catalog.refreshTable(self.name)
        return self

    def close(self) -> None:
        """Forget the forest in this application; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def drop(self) -> None:
        """Delete the forest."""
        self.close()
        drop_path(self.spark, self.path)


# --- look-up, verification, decision ---------------------------------------------


class _Steps:
    """Tables of one delivery, deleted together."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base, self.n = spark, scratch(spark, "delivery"), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        drop_path(self.spark, self.base)


def _sizes(threshold: float) -> Column:
    """Whether the set sizes of a pair (a, b) allow the threshold."""
    return F.least("a.n", "b.n") >= F.lit(threshold) * F.greatest("a.n", "b.n")


def _agree(a: str, b: str) -> Column:
    """Min-hash functions that agree, by four bits each; null if either has none."""
    agree = F.lit(FUNCTIONS)
    for k in range(FUNCTIONS // 16):
        x = F.element_at(a, k + 1).bitwiseXOR(F.element_at(b, k + 1))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        agree = agree - F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    return agree


def _allowed(a: DataFrame, b: DataFrame, threshold: float, exact: bool) -> Column:
    """Whether the set sizes of a pair (a, b) allow the threshold and, where both entries carry signatures, these do."""
    if exact or "fours" not in a.columns or "fours" not in b.columns:
        return _sizes(threshold)
    return _sizes(threshold) & F.coalesce(_agree("a.fours", "b.fours") >= AGREE, F.lit(True))


def lookups(entries: DataFrame, depth: int) -> DataFrame:
    """(route, low, ord, n, fours if there): where the label range begins that each entry looks for."""
    return entries.select("route", _low(F.col("label"), depth).alias("low"), "ord", "n", *(x for x in entries.columns if x == "fours"))


def candidates(asked: DataFrame, entries: DataFrame, depth: int, threshold: float = THRESHOLD, before: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """(dup, kept): look-ups and the earlier entries within their ranges, each pair once; with ``before`` (ord, best) only entries below best."""
    a = (asked if before is None else asked.join(before, "ord", "left")).alias("a")
    b = entries.alias("b")
    width = (1 << 8 * (LABEL - depth)) - 1
    inside = (F.col("a.route") == F.col("b.route")) & F.col("b.label").between(F.col("a.low"), F.col("a.low") + width) & (F.col("b.ord") < F.col("a.ord"))
    if before is not None:
        inside = inside & (F.col("a.best").isNull() | (F.col("b.ord") < F.col("a.best")))
    return b.join(a.hint("shuffle_hash"), inside & _allowed(a, b, threshold, exact)).select(F.col("a.ord").alias("dup"), F.col("b.ord").alias("kept")).distinct()


def meetings(asked: DataFrame, among: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(dup, kept): look-ups of one delivery with the same range, each pair once, ``kept`` the earlier."""
    a, b = asked.alias("a"), among.alias("b")
    same = (F.col("a.route") == F.col("b.route")) & (F.col("a.low") == F.col("b.low")) & (F.col("b.ord") < F.col("a.ord"))
    return a.join(b, same & _allowed(a, b, threshold, exact)).select(F.col("a.ord").alias("dup"), F.col("b.ord").alias("kept")).distinct()


def alike(pairs: DataFrame, dup_texts: DataFrame, kept_texts: DataFrame, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The stored pairs whose signatures (ord, fours, bottom) allow the threshold: at least ``AGREE`` min-hash functions agree,
    by four bits each, and of two long texts at least ``BOTH`` functions and smallest hashes."""

    def with_own(pairs: DataFrame, n: int, name: str) -> DataFrame:
        ids = pairs.select(F.col("dup").alias("ord")).distinct()
        a = dup_texts.select("ord", name).join(_small(ids, n), "ord", "left_semi").select(F.col("ord").alias("dup"), F.col(name).alias("a"))
        b = kept_texts.select(F.col("ord").alias("kept"), F.col(name).alias("b"))
        return b.join(_small(pairs, n), "kept").join(a, "dup")

    n = pairs.count()
    if not n:
        return pairs
    # The smallest hashes are longer; they are sent for the pairs that are left only.
    first = step(with_own(pairs, n, "fours").select("dup", "kept", _agree("a", "b").alias("agree")).filter(F.col("agree") >= AGREE))
    common = F.size(F.array_intersect(F.slice(F.array_sort(F.array_union("a", "b")), 1, BOTTOM), F.array_intersect("a", "b")))
    long = (F.size("a") > 0) & (F.size("b") > 0)
    return with_own(first, first.count(), "bottom").filter(F.when(long, F.col("agree") + common >= BOTH).otherwise(True)).select("dup", "kept")


def verified(pairs: DataFrame, dup_texts: DataFrame, kept_texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The stored pairs whose texts repeat each other, by exact set similarity of the normal texts (ord, text)."""
    n = pairs.count()
    if not n:
        return pairs

    ids = pairs.select(F.col("dup").alias("ord")).distinct()
    own = dup_texts.select("ord", "text").join(_small(ids, n), "ord", "left_semi").select(F.col("ord").alias("dup"), F.col("text").alias("a"))
    both = kept_texts.select(F.col("ord").alias("kept"), F.col("text").alias("b")).join(_small(pairs, n), "kept").join(own, "dup")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0

        def set_of(ord_: int, text: str) -> np.ndarray:
            nonlocal held
            own = known.get(ord_)
            if own is None:
                own = hashed(text)
                if held > MEMO:
                    known.clear()
                    held = 0
                known[ord_] = own
                held += len(own)
            return own

        for b in batches:
            hit = []
            for dup, kept, x, y in zip(*(b.column(k).to_pylist() for k in range(4))):
                if x == y or min(len(x), len(y)) <= SHINGLE:
                    own, other = shingles(x), shingles(y)
                    hit.append(x == y or len(own & other) >= threshold * len(own | other))
                    continue
                own, other = set_of(dup, x), set_of(kept, y)
                both_sorted = np.sort(np.concatenate((own, other)), kind="stable")
                common = int((both_sorted[1:] == both_sorted[:-1]).sum())
                share = common / (len(own) + len(other) - common)
                if abs(share - threshold) <= MARGIN:
                    # Hashes of different shingles may meet: near the threshold the shingles themselves decide.
                    one, two = shingles(x), shingles(y)
                    common = len(one & two)
                    hit.append(common >= threshold * (len(one) + len(two) - common))
                else:
                    hit.append(share > threshold)
            yield b.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    return both.select("dup", "kept", "a", "b").mapInArrow(check, "dup bigint, kept bigint")


def resolve(edges: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(dup, kept) of the rejected texts of a delivery by arrival order; ``edges`` are stored verified pairs of its texts.

    Rounds: a text without an undecided or accepted earlier neighbour is accepted, one with an accepted earlier
    neighbour rejected.  The rounds are as many as the longest chain of texts that hang on each other's fate.
    """
    open_, sure = edges, None
    while not open_.isEmpty():
        later = open_.select(F.col("dup").alias("node")).distinct()
        # Earlier neighbours that aren't themselves later than anything undecided are accepted now; the earliest always is.
        safe = step(open_.select(F.col("kept").alias("node")).distinct().join(later, "node", "left_anti"))
        sure = safe if sure is None else sure.union(safe)
        gone = open_.join(safe.select(F.col("node").alias("kept")), "kept", "left_semi").select("dup").distinct()
        # A rejected text no longer matters to later ones; those left without neighbours are accepted by themselves.
        open_ = step(open_.join(gone, "dup", "left_anti").join(gone.select(F.col("dup").alias("kept")), "kept", "left_anti").select("dup", "kept"))
    if sure is None:
        return edges
    return edges.join(sure.select(F.col("node").alias("kept")), "kept", "left_semi").groupBy("dup").agg(F.min("kept").alias("kept"))


def _against_history(forest: Forest, asked: DataFrame, n: int, signed: DataFrame, depth: int, threshold: float, exact: bool, step: _Steps) -> DataFrame:
    """(dup, kept) of the delivery's texts that repeat the history, with the first text they repeat."""
    old, left = forest.entries(), forest.rejected()

    def accepted(pairs: DataFrame) -> DataFrame:
        return pairs if left is None else pairs.join(left.select(F.col("ord").alias("kept")), "kept", "left_anti").select("dup", "kept")

    if n * TREES <= FEW:
        # Told as values, the routes let the scan choose its buckets and row groups.
        old = old.filter(F.col("route").isin([r[0] for r in asked.select("route").distinct().collect()]))
    wide, best = forest.wide_ranges(depth), None
    if wide is not None:
        first = asked.join(wide, ["route", "low"]).select(F.col("ord").alias("dup"), F.col("leader").alias("kept")).distinct()
        first = step(accepted(first))
        first = first if exact else step(alike(first, signed, forest.texts(), step))
        found = step(verified(first, signed, forest.texts(), threshold))
        best = step(found.groupBy(F.col("dup").alias("ord")).agg(F.min("kept").alias("best")))
    pairs = step(accepted(candidates(asked, old, depth, threshold, best, exact)))
    pairs = pairs if exact else step(alike(pairs, signed, forest.texts(), step))
    found = verified(pairs, signed, forest.texts(), threshold)
    if best is not None:
        found = found.unionByName(best.select(F.col("ord").alias("dup"), F.col("best").alias("kept")))
    return step(found.groupBy("dup").agg(F.min("kept").alias("kept")))


def _among_themselves(asked: DataFrame, signed: DataFrame, depth: int, threshold: float, exact: bool, step: _Steps) -> DataFrame:
    """(dup, kept) of the delivery's texts that repeat each other, none of which repeats the history."""
    # Most ranges hold one text of a delivery: only the others are looked at further.
    # Both steps work where the run's buckets lie; equality of range is written as a condition within equal routes for that.
    ranges = step(_ranges(asked).filter(F.col("size") > 1))
    a, r = asked.alias("a"), ranges.select("route", "low").alias("r")
    same = (F.col("a.route") == F.col("r.route")) & F.col("a.low").between(F.col("r.low"), F.col("r.low"))
    live = step(a.join(r.hint("shuffle_hash"), same, "left_semi"))
    whole, gone = live, None

    def checked(asked: DataFrame, among: DataFrame) -> DataFrame:
        met = step(meetings(asked, among, threshold, exact))
        return verified(met if exact else step(alike(met, signed, signed, step)), signed, signed, threshold)

    wide = ranges.filter(F.col("size") > WIDE)
    while not wide.isEmpty():
        # Texts that are first in all their wide ranges are leaders of this round: what they may repeat lies in narrow ranges.
        in_wide = step(live.join(wide.select("route", "low", "leader"), ["route", "low"]).select("ord", "leader"))
        lead = in_wide.groupBy("ord").agg(F.every(F.col("ord") == F.col("leader")).alias("leads")).filter("leads").select("ord")
        not_sure = checked(live.join(lead, "ord", "left_semi"), live).select(F.col("dup").alias("ord")).distinct()
        sure = step(lead.join(not_sure, "ord", "left_anti"))
        follow = in_wide.filter(F.col("ord") > F.col("leader")).join(sure.select(F.col("ord").alias("leader")), "leader", "left_semi")
        pairs = step(follow.select(F.col("ord").alias("dup"), F.col("leader").alias("kept")).distinct())
        pairs = pairs if exact else step(alike(pairs, signed, signed, step))
        repeat = step(verified(pairs, signed, signed, threshold).select(F.col("dup").alias("ord")).distinct())
        if repeat.isEmpty():
            break
        gone = repeat if gone is None else gone.union(repeat)
        live = step(live.join(repeat, "ord", "left_anti"))
        wide = step(_ranges(live).filter(F.col("size") > WIDE))
    rejected = resolve(step(checked(live, live)), step)
    if gone is None:
        return rejected
    rejected = step(rejected)
    # Of the texts that left their ranges: the first accepted one that each of them repeats.
    accepted = live.join(rejected.select(F.col("dup").alias("ord")), "ord", "left_anti")
    found = checked(whole.join(gone.distinct(), "ord", "left_semi"), accepted)
    return rejected.unionByName(found.groupBy("dup").agg(F.min("kept").alias("kept")))


def admit(
    forest: Forest, rows: DataFrame, is_new: Callable[[Column], Column] | None = None, threshold: float = THRESHOLD, recall: float = RECALL, least: int = LEAST, commit: bool = True, exact: bool = False
) -> DataFrame:
    """(dup, kept) orders of the rejected rows of a delivery.

    ``rows`` (ord, post, text) holds the delivery; if it holds more, ``is_new`` tells the delivery, and the rest isn't
    read.  With ``commit`` the accepted texts are added to the forest as a run.
    """
    spark, depth, step = forest.spark, depth_for(recall, threshold), _Steps(forest.spark)
    store, signed = _signed(forest, rows if is_new is None else rows.filter(is_new(F.col("ord"))), least)
    copies = step(copies_of(signed, step))
    # Written first as a run that isn't live, the delivery's entries meet the history's and each other bucket by bucket.
    run, n = forest.pending(_entries(signed.join(copies, "ord", "left_anti")))
    asked = lookups(spark.table(forest.name).filter(F.col("run") == run), depth)
    by_history = _against_history(forest, asked, n // TREES, signed, depth, threshold, exact, step)
    release(spark)
    fresh = asked.join(_small(by_history.select(F.col("dup").alias("ord")), by_history.count()), "ord", "left_anti")
    rejected = step(by_history.unionByName(_among_themselves(fresh, signed, depth, threshold, exact, step)))
    # Copies get their text's result; of an accepted text every later copy repeats the first.
    fate = copies.join(rejected.select(F.col("dup").alias("first"), "kept"), "first", "left")
    result = stored(rejected.unionByName(fate.select(F.col("ord").alias("dup"), F.coalesce("kept", "first").alias("kept"))), "rejected")
    if commit:
        forest.commit(run, n, store, rejected.select(F.col("dup").alias("ord")))
    else:
        drop_path(spark, f"{forest.path}/entries/run={run}")
        drop_path(spark, f"{forest.path}/texts/{store}")
    step.drop()
    release(spark)
    return result


def _signed(forest: Forest, rows: DataFrame, least: int) -> tuple[int, DataFrame]:
    """Sign a delivery into a new store of the forest."""
    store, path = forest.new_store()
    sign(rows, least).write.option("compression", "zstd").parquet(path)
    return store, forest.spark.read.schema(_SIGNED).parquet(path)


def build(spark: SparkSession, rows: DataFrame, least: int = LEAST, buckets: int | None = None, path: str | None = None) -> Forest:
    """Forest of an accepted history (ord, post, text)."""
    forest, step = Forest.create(spark, buckets, path), _Steps(spark)
    store, signed = _signed(forest, rows, least)
    run, n = forest.pending(_entries(signed.join(step(copies_of(signed, step)), "ord", "left_anti")))
    forest.commit(run, n, store)
    step.drop()
    release(spark)
    return forest
