"""Frequency of every term (problem 4): burst-trie counting.

Terms are maximal runs of letters, numbers and underscore of the lower-cased
raw text, without those made only of decimal digits.

Map side: a task counts into a burst trie.  A container holds up to
``BURST`` terms under its prefix and bursts into one container per next
character beyond that; occurrence and record counters sit in the containers.
A full trie (``TRIE_TERMS``) or the end of the partition writes every
container out as one row: prefix, number of terms, and the compact container
(sorted suffixes, counters).

Routing: the weights of all prefixes that containers were written under give
the heavy ones, and a container is cut further along them, so every route
(longest heavy prefix and one character more) holds a bounded number of
entries, however skewed the alphabet is.

Reduce side: matching subtrees of all workers meet by route and are merged.
No route is hot because of a frequent term: a worker sends a term once.

Defined cases: null texts hold no term and aren't records; empty texts are
records without terms; repeated rows count as often as they come; other
columns are ignored; an empty table gives no terms.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import spread

_RUN = re.compile(r"\w+")
#: Terms a container holds before it bursts.
BURST = 512
#: Terms a worker's trie holds before it is written out.
TRIE_TERMS = 300_000
#: Heavy prefixes kept: those with at least 1/MAX_HEAVY of all entries (at least MIN_ENTRIES).
MAX_HEAVY = 4096
MIN_ENTRIES = 20_000
MAX_DEPTH = 24


def terms_of(text: str) -> list[str]:
    """Terms of a raw text in order."""
    return [t for t in _RUN.findall(text.lower()) if not t.isdecimal()]


class BurstTrie:
    """Counters of terms in containers that burst by their next character."""

    __slots__ = ("limit", "root", "size")

    def __init__(self, limit: int = BURST) -> None:
        self.limit = limit
        self.root: dict = {}
        self.size = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        """Add counts to a term.

        A node is {"": container} while small; after its burst it maps a next character to a
        node, and "" to the counters of the term that ends there.
        """
        node, depth = self.root, 0
        while True:
            box = node.get("")
            if type(box) is dict or (box is None and not node):
                if box is None:
                    box = node[""] = {}
                key = term[depth:]
                old = box.get(key)
                if old is None:
                    box[key] = [occurrences, records]
                    self.size += 1
                    if len(box) > self.limit and depth < MAX_DEPTH:
                        self._burst(node, box)
                else:
                    old[0] += occurrences
                    old[1] += records
                return
            if depth == len(term):
                if box is None:
                    node[""] = [occurrences, records]
                    self.size += 1
                else:
                    box[0] += occurrences
                    box[1] += records
                return
            node = node.setdefault(term[depth], {})
            depth += 1

    @staticmethod
    def _burst(node: dict, box: dict) -> None:
        node.clear()
        for suffix, counts in box.items():
            if suffix == "":
                node[""] = counts
            else:
                child = node.setdefault(suffix[0], {"": {}})
                child[""][suffix[1:]] = counts
        # A burst node without a term of its own still must not look like a fresh one.
        if not node:
            node[""] = {}

    def containers(self) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
        """(prefix, [(suffix, occurrences, records)] in order) of every container."""
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            box = node.get("")
            if type(box) is dict:
                if box:
                    yield prefix, sorted((s, c[0], c[1]) for s, c in box.items())
            elif box is not None:
                yield prefix, [("", box[0], box[1])]
            todo += [(prefix + ch, child) for ch, child in node.items() if ch != ""]


def pack(entries: list[tuple[str, int, int]]) -> bytes:
    """A container as bytes: the counters, then the suffixes."""
    n = len(entries)
    occ = [e[1] for e in entries]
    rec = [e[2] for e in entries]
    return struct.pack(f"<I{n}Q{n}Q", n, *occ, *rec) + "\0".join(e[0] for e in entries).encode("utf-8", "surrogatepass")


def unpack(blob: bytes) -> list[tuple[str, int, int]]:
    """Entries of a packed container."""
    (n,) = struct.unpack_from("<I", blob)
    counts = struct.unpack_from(f"<{2 * n}Q", blob, 4)
    suffixes = blob[4 + 16 * n :].decode("utf-8", "surrogatepass").split("\0")
    return list(zip(suffixes, counts[:n], counts[n:]))


_CONTAINER = pa.schema([("prefix", pa.string()), ("entries", pa.int64()), ("box", pa.binary())])


def _write(trie: BurstTrie) -> pa.RecordBatch:
    rows = [(p, len(es), pack(es)) for p, es in trie.containers()]
    prefix, entries, box = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(prefix, pa.string()), pa.array(entries, pa.int64()), pa.array(box, pa.binary())], schema=_CONTAINER)


def count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to containers, map side."""
    trie = BurstTrie()
    for b in batches:
        occ: Counter[str] = Counter()
        rec: Counter[str] = Counter()
        for text in b.column(0).to_pylist():
            if text:
                found = _RUN.findall(text.lower())
                occ.update(found)
                rec.update(set(found))
        add = trie.add
        for term, n in occ.items():
            if not term.isdecimal():
                add(term, n, rec[term])
        if trie.size >= TRIE_TERMS:
            yield _write(trie)
            trie = BurstTrie()
    if trie.size:
        yield _write(trie)


class Router:
    """Routes of terms along heavy prefixes."""

    def __init__(self, heavy: set[str]) -> None:
        self.heavy = heavy

    def route(self, term: str) -> str:
        """Longest heavy prefix and one more character; the term itself where it ends there."""
        k = 0
        while k < len(term) and term[:k] in self.heavy:
            k += 1
        return term[:k]

    def cut(self, prefix: str, entries: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
        """A container as (route, [(term, ...)]) parts; one part unless heavy prefixes run through it."""
        parts: dict[str, list[tuple[str, int, int]]] = {}
        whole = self.route(prefix + "\U0010ffff") if prefix else ""
        if prefix and len(whole) <= len(prefix):
            yield whole, [(prefix + s, o, r) for s, o, r in entries]
            return
        for s, o, r in entries:
            term = prefix + s
            parts.setdefault(self.route(term), []).append((term, o, r))
        yield from parts.items()


def frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, occurrences, records) of every term."""
    boxes = spread(df.select(F.col(text_col).alias("text")).filter("text is not null")).mapInArrow(
        count_partition, "prefix string, entries bigint, box binary"
    )
    # Read for the weights and for the merge; a lost part is counted again.
    boxes = boxes.persist(StorageLevel.DISK_ONLY)
    depths = F.explode(F.transform(F.sequence(F.lit(0), F.least(F.length("prefix"), F.lit(MAX_DEPTH))), lambda k: F.substring(F.col("prefix"), F.lit(1), k)))
    weights = boxes.groupBy("prefix").agg(F.sum("entries").alias("entries")).select(depths.alias("p"), "entries").groupBy("p").agg(F.sum("entries").alias("w"))
    total = boxes.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    floor = max(MIN_ENTRIES, total // MAX_HEAVY)
    # At each depth at most MAX_HEAVY prefixes can weigh this much: bounded whatever the corpus.
    heavy = {r["p"] for r in weights.filter(F.col("w") >= floor).collect()}
    router = Router(heavy)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, bytes]] = []
            for prefix, box in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out += [(route, pack(part)) for route, part in router.cut(prefix, unpack(box))]
            yield pa.RecordBatch.from_pydict({"route": [r for r, _ in out], "box": pa.array([x for _, x in out], pa.binary())})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        trie: dict[str, list[int]] = {}
        for box in pdf["box"]:
            for term, o, r in unpack(box):
                old = trie.get(term)
                if old is None:
                    trie[term] = [o, r]
                else:
                    old[0] += o
                    old[1] += r
        return pd.DataFrame({"term": list(trie), "occurrences": [c[0] for c in trie.values()], "records": [c[1] for c in trie.values()]})

    def merge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by route: a route's parts follow each other; one route is held at a time.
        route, boxes_ = None, []
        for b in batches:
            for r, box in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if r != route and boxes_:
                    yield _merged(boxes_)
                    boxes_ = []
                route = r
                boxes_.append(box)
        if boxes_:
            yield _merged(boxes_)

    def _merged(found: list[bytes]) -> pa.RecordBatch:
        pdf = merge(pd.DataFrame({"box": found}))
        return pa.RecordBatch.from_arrays(
            [pa.array(pdf["term"].tolist(), pa.string()), pa.array(pdf["occurrences"].tolist(), pa.int64()), pa.array(pdf["records"].tolist(), pa.int64())],
            names=["term", "occurrences", "records"],
        )

    routed = boxes.select("prefix", "box").mapInArrow(cut, "route string, box binary")
    parts = routed.repartition("route").sortWithinPartitions("route")
    return parts.mapInArrow(merge_all, "term string, occurrences bigint, records bigint")


def marked(df: DataFrame, text_col: str = "text", common_share: float = 0.05) -> DataFrame:
    """``frequencies`` with mark: rare (in one record), common (in more than the share of records with a text), else null."""
    texts = df.agg(F.count(text_col).alias("texts"))
    freq = frequencies(df, text_col)
    # One row, so the join is a broadcast of a single number.
    return freq.join(F.broadcast(texts)).select(
        "term",
        "occurrences",
        "records",
        F.when(F.col("records") == 1, "rare").when(F.col("records") > F.col("texts") * F.lit(common_share), "common").alias("mark"),
    )

