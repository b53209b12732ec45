"""Byte-level BPE over a public rank file: exact ids and exact counts.

``Encoder`` gives ids by two tiers: a minimal perfect hash answers pre-tokens
that are vocabulary entries as a whole; the others are merged over a linked
list of bytes with a heap of candidate merges.  ``Counter`` gives the number
of ids without making them: an automaton over the vocabulary finds every entry
that ends at a byte, and a dynamic program keeps the one entry whose pairing
with its predecessor is one that the merges would leave alone.

Both work on pre-tokens (the published split pattern) and keep a bounded memo
of pre-tokens seen by the worker; the memo only saves time.
Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable

import ahocorasick
import numpy as np
import regex
import xxhash

#: Where the public vocabularies lie; never copied into the repository.
TOKENIZER_DIR = os.environ.get("WARRAQ_TOKENIZERS", "/opt/tokenizers")
#: Pre-tokens kept by a worker before its memo is emptied.
MEMO_SIZE = 400_000
_LONG = 64  # bytes; longer pre-tokens aren't kept

# Fixed value: the published split pattern of these rank files.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def rank_path(name: str, folder: str | None = None) -> str:
    """File of a rank vocabulary such as ``byte_bpe_50k``."""
    return os.path.join(folder or TOKENIZER_DIR, name if name.endswith(".tiktoken") else f"{name}.tiktoken")


def load_ranks(path: str) -> list[bytes]:
    """Vocabulary entries in id order."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    entries: list[bytes] = [b""] * len(pairs)
    for word, rank in pairs:
        entries[int(rank)] = base64.b64decode(word)
    return entries


class PerfectHash:
    """Minimal perfect hash over the entries by displacement; one probe and one comparison an answer."""

    def __init__(self, entries: list[bytes]) -> None:
        n = self.n = len(entries)
        groups = self.groups = max(1, n * 2 // 3)
        digests = [xxhash.xxh3_64_intdigest(e) for e in entries]
        by_group: list[list[int]] = [[] for _ in range(groups)]
        for k, d in enumerate(digests):
            by_group[d % groups].append(k)
        self.shift = [0] * groups
        self.slot = [-1] * n
        free = 0
        for g in sorted(range(groups), key=lambda g: -len(by_group[g])):
            members = by_group[g]
            if not members:
                break
            if len(members) == 1:
                # Groups of one are sent straight to the next free slot.
                while self.slot[free] >= 0:
                    free += 1
                self.shift[g] = -free - 1
                self.slot[free] = members[0]
                continue
            seed = 1
            while True:
                places = {self._place(digests[k], seed) for k in members}
                if len(places) == len(members) and all(self.slot[p] < 0 for p in places):
                    break
                seed += 1
            self.shift[g] = seed
            for k in members:
                self.slot[self._place(digests[k], seed)] = k
        self.entries = entries

    def _place(self, digest: int, seed: int) -> int:
        x = (digest ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x >> 32) % self.n

    def get(self, key: bytes) -> int:
        """Id of ``key``, or -1."""
        digest = xxhash.xxh3_64_intdigest(key)
        seed = self.shift[digest % self.groups]
        k = self.slot[-seed - 1 if seed < 0 else self._place(digest, seed)]
        return k if self.entries[k] == key else -1


class Vocabulary:
    """Entries, merge order and splits of one rank file."""

    def __init__(self, path: str) -> None:
        self.entries = load_ranks(path)
        self.ids = {e: k for k, e in enumerate(self.entries)}
        self._parts: dict[int, tuple[int, int] | None] = {}

    def merge(self, piece: bytes, below: int | None = None) -> list[tuple[int, int, int]]:
        """(id, start, end) by applying the merges in rank order; ``below``: only merges of lower rank.

        The bytes are a doubly linked list; the heap holds the merges that are possible now.
        """
        n = len(piece)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        end = list(range(1, n + 1))
        rank = self.ids.get
        heap: list[tuple[int, int, int]] = []
        for i in range(n - 1):
            r = rank(piece[i : i + 2])
            if r is not None and (below is None or r < below):
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            r, i, stop = heapq.heappop(heap)
            # Stale if the left part was merged away or either part has changed since.
            if not alive[i] or right[i] >= n or end[right[i]] != stop or end[i] >= stop:
                continue
            if self.ids.get(piece[i:stop]) != r:
                continue
            j = right[i]
            alive[j] = 0
            end[i] = stop
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
                t = rank(piece[i : end[right[j]]])
                if t is not None and (below is None or t < below):
                    heapq.heappush(heap, (t, i, end[right[j]]))
            if left[i] >= 0:
                t = rank(piece[left[i] : stop])
                if t is not None and (below is None or t < below):
                    heapq.heappush(heap, (t, left[i], stop))
        out, i = [], 0
        while i < n:
            out.append((self.ids[piece[i : end[i]]], i, end[i]))
            i = right[i]
        return out

    def parts(self, k: int) -> tuple[int, int] | None:
        """The two entries that entry ``k`` is merged from; None for a single byte."""
        if k not in self._parts:
            e = self.entries[k]
            two = self.merge(e, below=k) if len(e) > 1 else []
            self._parts[k] = (two[0][0], two[1][0]) if len(two) == 2 else None
        return self._parts[k]


class _Memo(dict):
    """Answers by pre-token; works a missing one out and keeps it, up to ``MEMO_SIZE``."""

    def __init__(self, work) -> None:
        super().__init__()
        self._work = work

    def __missing__(self, s: str):
        value = self._work(s)
        if len(s) <= _LONG:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[s] = value
        return value


class Encoder:
    """Exact ids of whole texts."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.hash = PerfectHash(self.vocabulary.entries)
        self.memo = _Memo(self._piece)

    def _piece(self, s: str) -> bytes:
        b = s.encode("utf-8", "surrogatepass")
        whole = self.hash.get(b)
        ids = [whole] if whole >= 0 else [k for k, _, _ in self.vocabulary.merge(b)]
        return np.asarray(ids, dtype=np.int32).tobytes()

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as little-endian int32; empty for null and empty."""
        return b"".join(map(self.memo.__getitem__, SPLIT.findall(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; the empty list for null and empty."""
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()


class Counter:
    """Exact number of ids, without making them."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for k, e in enumerate(self.vocabulary.entries):
            self.automaton.add_word(e.decode("latin-1"), (k, len(e)))
        self.automaton.make_automaton()
        self.memo = _Memo(self._piece)
        self._fits: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave entry ``a`` followed by entry ``b`` as they are.

        Walks both entries back through the merges that made them, latest first, and looks
        at each state of the seam for a merge across it that would have come sooner.
        """
        key = (a, b)
        known = self._fits.get(key)
        if known is not None:
            return known
        v = self.vocabulary
        limit, left, right, ok = len(v.entries), a, b, True
        while True:
            across = v.ids.get(v.entries[left] + v.entries[right])
            if across is not None and across < limit and self._joins(left, right, across):
                ok = False
                break
            lp, rp = v.parts(left), v.parts(right)
            if lp is None and rp is None:
                break
            # Undo the later of the two last merges; at equal ranks the left one is done first.
            if rp is None or (lp is not None and left > right):
                limit, left = left, lp[1]  # type: ignore[index]
            else:
                limit, right = right + 1, rp[0]
        if len(self._fits) >= MEMO_SIZE:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def _joins(self, left: int, right: int, across: int) -> bool:
        return self.vocabulary.parts(across) == (left, right)

    def _piece(self, s: str) -> int:
        b = s.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(b)
        last = [-1] * (n + 1)  # entry that ends the encoding of the first i bytes
        count = [0] * (n + 1)
        fits = self.fits
        for stop, (k, size) in self.automaton.iter(b):
            i = stop + 1
            start = i - size
            # Exactly one entry ends the encoding of a prefix; the longest come first.
            if last[i] < 0 and (start == 0 or (last[start] >= 0 and fits(last[start], k))):
                last[i] = k
                count[i] = count[start] + 1
        return count[n]

    def count(self, text: str | None) -> int:
        """Number of ids of a text; 0 for null and empty."""
        return sum(map(self.memo.__getitem__, SPLIT.findall(text))) if text else 0


_LOADED: dict[tuple[type, str], Encoder | Counter] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a rank file, loaded once a process."""
    key = (Encoder, path)
    if key not in _LOADED:
        _LOADED[key] = Encoder(path)
    return _LOADED[key]  # type: ignore[return-value]


def counter(path: str) -> Counter:
    """The worker's counter of a rank file, loaded once a process."""
    key = (Counter, path)
    if key not in _LOADED:
        _LOADED[key] = Counter(path)
    return _LOADED[key]  # type: ignore[return-value]


def encode_batch(path: str, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, offsets) of a batch."""
    packed = list(map(encoder(path).packed, texts))
    sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
    return np.frombuffer(b"".join(packed), dtype=np.int32), np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
