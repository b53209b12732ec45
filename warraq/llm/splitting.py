"""Splitting texts that exceed a token limit (problem 10).

Recursive bisection over the pre-tokens of a text: a span longer than
``max_tokens - overlap_tokens`` is cut at the strongest boundary in its middle
part (paragraph, line, sentence, word; inside a word only if there is no other
place), nearest to the midpoint, and both halves are treated alike.  Then each
piece but the first is extended to the left by the ``overlap_tokens`` tokens
before it.

Guarantees: a piece has at most ``max_tokens`` tokens when encoded by itself;
pieces without their overlaps join to the text; the overlap has exactly
``overlap_tokens`` tokens of the text's encoding, or fewer where that would
start inside a character or exceed the limit.  Texts within the limit (null
and empty ones too) are left out, or kept whole with ``keep_short``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import spread
from . import bpe
from .tokens import DEFAULT

PARAGRAPH, LINE, SENTENCE, WORD, NONE, INSIDE = 4, 3, 2, 1, 0, -1
#: Pre-tokens of more tokens than this also give places to cut inside them.
BIG = 16


def _table(points: list[int]) -> np.ndarray:
    t = np.zeros(0x10000, dtype=bool)
    t[points] = True
    t[0xFFFF] = False  # stands for all characters beyond
    return t


_STOP = _table([ord(c) for c in ".!?\u061f;\u061b\u2026\u3002\uff01\uff1f"])
_CLOSER = _table([ord(c) for c in "\"'\u00bb\u201d\u2019)]}"])
_SPACE = _table([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


_INSIDE: dict[str, tuple[list[int], list[int]]] = {}


class Places:
    """Where a text may be cut: character and token position and strength, by pre-token (and inside big ones)."""

    def __init__(self, text: str, encoder: bpe.Encoder) -> None:
        self.text, self.encoder = text, encoder
        memo = encoder.memo
        pieces = bpe.SPLIT.findall(text)
        n = np.fromiter(map(len, map(memo.__getitem__, pieces)), dtype=np.int64, count=len(pieces)) // 4
        chars = np.concatenate(([0], np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))))
        toks = np.concatenate(([0], np.cumsum(n)))
        self.total = int(toks[-1])
        self._chars, self._toks = chars, toks
        self.pre_chars: list[int] = []
        self.pre_toks: list[int] = []
        self._pieces, self._sizes = pieces, n
        self.chars: list[int] = []
        self.toks: list[int] = []
        self.strong = np.zeros(0, dtype=np.int64)
        #: Places by strength, the strongest first.
        self.levels: list[tuple[int, list[int]]] = []

    def prepare(self) -> None:
        """Strengths, and the places inside big pre-tokens."""
        chars, toks = self._chars, self._toks
        self.pre_chars, self.pre_toks = chars.tolist(), toks.tolist()
        cp = np.minimum(np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF)
        space = _SPACE[cp]
        at = chars[:-1]
        newline = (cp == 10) | (cp == 0x2029)
        newline |= (cp == 13) & np.concatenate((cp[1:] != 10, [True]))
        upto = np.concatenate(([0], np.cumsum(newline)))
        index = np.arange(len(cp) + 1)
        # For each position the start of the white space that ends there.
        start = np.maximum.accumulate(np.where(np.concatenate(([True], ~space)), index, 0))
        begins_blank = space[at]
        after_space = np.concatenate(([False], space))[at]
        breaks = upto[at] - upto[start[at]]
        word = (begins_blank & ~after_space & ~newline[at]) | (after_space & ~begins_blank)
        strong = np.where(word, WORD, NONE)
        strong = np.where(~begins_blank & (breaks == 1), LINE, np.where(~begins_blank & (breaks > 1), PARAGRAPH, strong))
        end = np.maximum(start[at] - 1, 0)
        closed = np.where(_CLOSER[cp[end]], np.maximum(end - 1, 0), end)
        strong = np.where((strong == WORD) & _STOP[cp[closed]], SENTENCE, strong)
        # White space alone is no place: the cut comes after it.
        blank_piece = space[at] & space[np.maximum(chars[1:] - 1, 0)]
        strong = np.where(blank_piece, NONE, strong)
        strong[:1] = NONE
        strong = np.concatenate((strong, [NONE]))
        big = np.flatnonzero(self._sizes > BIG)
        if len(big):
            parts = [self.inside(k) for k in big.tolist()]
            ic = np.array([x for c, _ in parts for x in c], dtype=np.int64)
            it = np.array([x for _, t in parts for x in t], dtype=np.int64)
            order = np.argsort(np.concatenate((chars, ic)), kind="stable")
            self.chars = np.concatenate((chars, ic))[order].tolist()
            self.toks = np.concatenate((toks, it))[order].tolist()
            self.strong = np.concatenate((strong, np.full(len(ic), INSIDE)))[order]
        else:
            self.chars, self.toks, self.strong = self.pre_chars, self.pre_toks, strong
        self.levels = [(s, np.flatnonzero(self.strong == s).tolist()) for s in sorted(set(self.strong.tolist()), reverse=True)]

    def inside(self, k: int) -> tuple[list[int], list[int]]:
        """(characters, tokens) of the token ends inside pre-token ``k`` that are character ends."""
        s = self._pieces[k]
        known = _INSIDE.get(s)
        if known is None:
            ids = np.frombuffer(self.encoder.memo[s], dtype=np.int32)
            entries = self.encoder.vocabulary.entries
            ends = np.cumsum([len(entries[i]) for i in ids.tolist()])[:-1]
            b = np.frombuffer(s.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            lead = (b & 0xC0) != 0x80
            ok = lead[ends]
            known = ((np.cumsum(lead) - 1)[ends[ok]].tolist(), (1 + np.flatnonzero(ok)).tolist())
            if len(s) <= 64:
                if len(_INSIDE) >= bpe.MEMO_SIZE:
                    _INSIDE.clear()
                _INSIDE[s] = known
        c, t = self.pre_chars[k], self.pre_toks[k]
        return [c + x for x in known[0]], [t + x for x in known[1]]

    def count(self, start: int, stop: int) -> int:
        """Tokens of ``text[start:stop]`` encoded by itself.

        Between pre-token ends the split of a part is that of the whole, but for white space at
        its end; only the parts of pre-tokens at either end are encoded again.
        """
        c, t = self.pre_chars, self.pre_toks
        a, z = bisect_left(c, start), bisect_right(c, stop) - 1
        # White space at the end joins into one pre-token.
        while z > a and self._pieces[z - 1].isspace():
            z -= 1
        if a > z or c[z] <= start:
            return self._encoded(start, stop)
        n = t[z] - t[a]
        if c[a] > start:
            if "'" in self.text[start : c[a]]:
                return self._encoded(start, stop)
            n += self._encoded(start, c[a])
        if c[z] < stop:
            n += self._encoded(c[z], stop)
        return n

    def _encoded(self, start: int, stop: int) -> int:
        return len(self.encoder.packed(self.text[start:stop])) // 4

    def back(self, place_tok: int, tokens: int) -> Iterator[int]:
        """Character positions, first the one ``tokens`` before the token position, then later ones, to start an overlap."""
        want = place_tok - tokens
        if want <= 0:
            want = 0
        k = bisect_right(self.pre_toks, want) - 1
        if self.pre_toks[k] == want:
            yield self.pre_chars[k]
        elif self._sizes[k] > 1:
            for c, t in zip(*self.inside(k)):
                if want <= t < place_tok:
                    yield c
        for j in range(k + 1, bisect_left(self.pre_toks, place_tok)):
            yield self.pre_chars[j]


class Splitter:
    """Splits texts by limits; exact by the encoder."""

    def __init__(self, encoder: bpe.Encoder) -> None:
        self.encoder = encoder

    @staticmethod
    def _place(toks: list[int], levels: list[tuple[int, list[int]]], a: int, z: int) -> int:
        """Index of the place between ``a`` and ``z`` to cut at: the strongest near the midpoint; -1 if there is none."""
        size, mid = toks[z] - toks[a], (toks[a] + toks[z]) / 2
        # The middle half first; all of the span where that has no word end, or no place at all.
        for share, least in ((0.25, WORD), (0.5, WORD), (0.25, INSIDE), (0.5, INSIDE)):
            lo = bisect_left(toks, mid - size * share, a + 1, z)
            hi = bisect_right(toks, mid + size * share, a + 1, z)
            if lo >= hi:
                continue
            for strength, places in levels:
                if strength < least:
                    break
                if (first := bisect_left(places, lo)) < len(places) and places[first] < hi:
                    # The nearest of the strongest on either side of the midpoint.
                    k = bisect_left(places, bisect_left(toks, mid, lo, hi), first)
                    return min((places[q] for q in (k - 1, k) if first <= q < len(places) and places[q] < hi), key=lambda q: abs(toks[q] - mid))
        return -1

    def _cuts(self, toks: list[int], levels: list[tuple[int, list[int]]], limit: int) -> list[int]:
        """Indexes of the places to cut at, in order."""
        cuts: list[int] = []
        todo = [(0, len(toks) - 1)]
        while todo:
            a, z = todo.pop()
            if toks[z] - toks[a] > limit and z - a > 1 and (best := self._place(toks, levels, a, z)) >= 0:
                cuts.append(best)
                todo += [(a, best), (best, z)]
        return sorted(cuts)

    def split(self, text: str, limits: list[tuple[int, int]]) -> list[list[tuple[int, int, int, int]]]:
        """For each (max_tokens, overlap): (overlap start, start, end, tokens) by characters; [] within the limit."""
        places = Places(text, self.encoder)
        ready, out = False, []
        for most, overlap in limits:
            if places.total <= most:
                out.append([])
                continue
            if not ready:
                places.prepare()
                ready = True
            out.append(self._pieces(places, most, overlap))
        return out

    def _pieces(self, p: Places, most: int, overlap: int) -> list[tuple[int, int, int, int]]:
        places, toks = p.chars, p.toks
        edges = [0, *self._cuts(toks, p.levels, max(1, most - overlap)), len(places) - 1]
        todo = [(edges[k], edges[k + 1]) for k in range(len(edges) - 1)][::-1]
        out: list[tuple[int, int, int, int]] = []
        while todo:
            a, z = todo.pop()
            start, stop = places[a], places[z]
            if start == stop:
                continue
            n = p.count(start, stop)
            if n > most and z - a > 1:
                # Encoded alone a span can need a few tokens more: it is cut once again, in the same way.
                m = self._place(toks, p.levels, a, z)
                m = m if m > 0 else (a + z) // 2
                todo += [(m, z), (a, m)]
                continue
            first = start
            if start and overlap:
                for c in p.back(toks[a], overlap):
                    with_overlap = p.count(c, stop)
                    if with_overlap <= most:
                        first, n = c, with_overlap
                        break
            out.append((first, start, stop, n))
        return out


def split(
    df: DataFrame,
    limits: list[tuple[str, int, int]],
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = DEFAULT,
    keep_short: bool = False,
    folder: str | None = None,
) -> DataFrame:
    """Pieces of every text longer than a limit: (limit_name, id, piece_no, start, overlap_chars, n_tokens, piece).

    ``limits`` are (name, max_tokens, overlap_tokens), few and given by the user.  ``start`` is the
    code point at which the piece without its overlap begins.  One pass, no shuffle; a text is cut
    where it is, so that no group of pieces is ever gathered.
    """
    path = bpe.rank_path(tokenizer, folder)
    kind = df.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("limit_name", T.StringType()),
            T.StructField(id_col, kind),
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("overlap_chars", T.IntegerType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("piece", T.StringType()),
        ]
    )
    least = min((m for _, m, _ in limits), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(bpe.encoder(path))
        names = schema.fieldNames()
        for b in batches:
            ids = b.column(0)
            rows: list[tuple] = []
            took: list[int] = []
            for k, text in enumerate(b.column(1).to_pylist()):
                # A token is at least a byte, so shorter texts are within every limit.
                long = text is not None and len(text) * 4 > least
                found = splitter.split(text, [(m, o) for _, m, o in limits]) if long else [[]] * len(limits)
                for (name, _, _), pieces in zip(limits, found):
                    if not pieces and keep_short:
                        pieces = [(0, 0, len(text or ""), len(splitter.encoder.packed(text)) // 4)]
                    for no, (first, start, stop, n) in enumerate(pieces):
                        took.append(k)
                        rows.append((name, no, start, start - first, n, text[first:stop] if text is not None else None))
                if len(rows) >= 4000:
                    yield _batch(rows, ids.take(pa.array(took)), names)
                    rows, took = [], []
            if rows:
                yield _batch(rows, ids.take(pa.array(took)), names)

    return spread(df.select(id_col, text_col)).mapInArrow(run, schema)


def _batch(rows: list[tuple], ids: pa.Array, names: list[str]) -> pa.RecordBatch:
    name, no, start, over, n, piece = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(name, pa.string()), ids, pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(over, pa.int32()), pa.array(n, pa.int32()), pa.array(piece, pa.string())],
        names=names,
    )


def read_limits(limits: DataFrame) -> list[tuple[str, int, int]]:
    """The rows of a limits table, a handful by its purpose."""
    rows = limits.select(F.col("limit_name"), F.col("max_tokens"), F.col("overlap_tokens")).collect()
    return sorted((r[0], int(r[1]), int(r[2] or 0)) for r in rows if r[1] is not None)
