"""Template residue, error pages, script notices and filler (problem 3).

Named template fields are a matter of form and are found by a pattern.  For
the rest three character n-gram models are fit (filler, notices, natural
prose); each position of a text gets the log-likelihood ratio of its longest
n-gram that some model has seen (four characters, else three with less
weight), windows whose mean ratio is high localise residue, and a record is
residue if that covers enough of what it says, navigation words left aside.
Filler that says nothing in any language is marked in the same coverage: words
of neighbouring keys, words of one letter, and one word again and again.

The natural model is fit on all texts of the table of language samples, counted
where they lie, and on sentences that speak of such things; the others on
``residue_seeds``.  All text of all records is scored.

Defined cases: null and blank texts are no residue; a table without samples
leaves the natural model with its seeds; repeats are judged alike; extra
columns are ignored (``flag``) or kept (``exclude``).
"""

from __future__ import annotations

import builtins
import re
import types
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import spread
from .residue_seeds import KEYBOARDS, filler_seed, fillers, notices, spoken

__all__ = ["NOTICES", "Judge", "exclude", "filler_seed", "fit", "flag", "is_residue", "read_prose"]

#: Orders of the n-grams, the longest first, and the weight of a ratio by order.
ORDERS, WEIGHTS = (4, 3), (1.0, 0.5)
WINDOW = 20
#: A window is residue above this mean ratio; a record above this coverage.
RATIO, COVERAGE = 0.5, 0.6
_SIZE = 1 << 18
_EPS = 2e-5

# --- template fields --------------------------------------------------------

_FIELD_NAME = r"[^\W\d][\w.\-]*(?:\s?\|\s?\w+)?"
# Names between double underscores that the programming language itself defines are code, not fields.
_CODE = sorted({n[2:-2] for t in (*(x for x in vars(builtins).values() if isinstance(x, type)), types.ModuleType("m"), types.FunctionType) for n in dir(t) if n.startswith("__") and n.endswith("__")} | {"main", "file", "all", "path", "enter", "exit"})
_FIELD = re.compile(
    rf"\{{\{{\{{?\s*{_FIELD_NAME}\s*\}}?\}}\}}|\$\{{\s*{_FIELD_NAME}\s*\}}|#\{{\s*{_FIELD_NAME}\s*\}}|<%[=-]?\s*{_FIELD_NAME}\s*-?%>|<<\s*{_FIELD_NAME}\s*>>"
    rf"|\[\[\s*{_FIELD_NAME}\s*\]\]|(?<![\w%])%[^\W\d][\w.\-]*%(?!\w)|(?<!\w)__(?!(?:{'|'.join(_CODE)})__)[^\W\d_][\w.\-]*?__(?!\w)"
    rf"|(?<![{{$#\w])\{{\s*[^\W\d][\w.\-]*\s*\}}(?!\}})|\[INSERT\s+{_FIELD_NAME}\s+HERE\]|@@[^\W\d][\w.\-]*@@",
    re.I,
)

NOTICES = notices()

# --- models -----------------------------------------------------------------


def _fold(text: str) -> str:
    """Lower case, digits alike, marks removed, white space single."""
    text = re.sub("[ً-ٰٟـ​-‏﻿]", "", text.lower())
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", text))


# Names that programs give to errors, and positions in source files, read as what they are.
_ERROR_NAME = re.compile(r"\b[A-Z]{2,}(?:_[A-Z\d]{2,}){1,}\b|\b(?:[a-z]+\.)*(?:[A-Z][a-z\d]+)+(?:Exception|Error)\b|\b[A-Z]{2,5}-\d{4,}\b")
_SOURCE_HINT = re.compile(r"\.(?:php|py|java|js|inc|asp|jsp|rb)\b")
_SOURCE_LINE = re.compile(r"(?:\bat |\bin |File )?(?<![/\w.-])[\"'(/\w.\\-]{1,200}\.(?:php|py|java|js|inc|asp|jsp|rb)\b[\"')]*(?::\d+|,? (?:on )?line \d+)")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(f" {_fold(text)} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(cp: np.ndarray, n: int) -> np.ndarray:
    """Table slots of the n-grams of code points."""
    h = cp[: len(cp) - n + 1].astype(np.uint32)
    for k in range(1, n):
        h = h * np.uint32(0x01000193) ^ cp[k : len(cp) - n + 1 + k]
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 18)).astype(np.int64)


def _counts(texts: list[str], n: int) -> np.ndarray:
    total = np.zeros(_SIZE)
    for t in texts:
        cp = _points(t)
        if len(cp) >= n:
            np.add.at(total, _grams(cp, n), 1)
    return total


def _all_counts(texts: list[str]) -> np.ndarray:
    """(orders, slots) of texts."""
    return np.stack([_counts(texts, n) for n in ORDERS])


def fit(prose: list[str] | np.ndarray) -> np.ndarray:
    """(2 models, 2 orders, slots): log-likelihood ratios of notices and of filler against prose (texts, or counts of ``read_prose``); nan where no model has seen the n-gram."""
    counted = prose if isinstance(prose, np.ndarray) else _all_counts([p for p in prose if p])
    out = np.full((2, len(ORDERS), _SIZE), np.nan, dtype=np.float32)
    for k, n in enumerate(ORDERS):
        own, about = counted[k], _counts(spoken(), n)
        # Sentences that speak of residue weigh as much as a notice that says the same.
        natural = 0.8 * own / max(1.0, own.sum()) + 0.2 * about / about.sum()
        # Square roots: a seed made by rule repeats its parts far more often than a writer would.
        models = [np.sqrt(_counts(seeds, n)) for seeds in (NOTICES, fillers())]
        seen = (natural > 0) | (models[0] > 0) | (models[1] > 0)
        for m, c in enumerate(models):
            out[m, k, seen] = np.clip(np.log((c / c.sum() + _EPS) / (natural + _EPS)), -3, 3)[seen]
    return out


_SPLIT_ITEMS = re.compile(r"\s+[|>·•»]\s+|[\r\n]+")
_TRAILER = re.compile(r"\s*(?:\(\d+[.,]\d+s\)|#\d+)\s*$")


_WORD = re.compile(r"[^\W\d_]+")
_NEXT_KEY = frozenset(a + b for row in KEYBOARDS for a, b in zip(row, row[1:])) | frozenset(b + a for row in KEYBOARDS for a, b in zip(row, row[1:]))
#: Words that say each other again this often on the average, within twice as many words, are filler.
AGAIN = 4


@lru_cache(maxsize=1 << 16)
def _senseless(word: str) -> bool:
    """A word of neighbouring keys, or of the letter x or z alone."""
    if len(word) >= 3 and set(word) <= {"x"} or len(word) >= 3 and set(word) <= {"z"}:
        return True
    return len(word) >= 4 and sum(word[k : k + 2] in _NEXT_KEY for k in range(len(word) - 1)) >= 0.75 * (len(word) - 1)


def meaningless(text: str, folded: bool = False) -> list[tuple[int, int]]:
    """Stretches of the (folded) text that say nothing in any language."""
    text = text if folded else _fold(text)
    words = _WORD.findall(text)
    # One word, or two, again and again, laughter and single letters aside.  Looked for in short windows: a long text
    # says most of its words again.
    span = min(2 * AGAIN, len(words))
    again = np.empty(0, dtype=np.int64)
    if span >= AGAIN and sum(map(eq, words, words[1:])) + sum(map(eq, words, words[2:])) >= span - 2:
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
        plain = np.array([len(set(w)) > 2 for w in number])[ids]
        windows = np.sort(np.lib.stride_tricks.sliding_window_view(ids, span), axis=1)
        distinct = 1 + (windows[:, 1:] != windows[:, :-1]).sum(axis=1)
        said = np.lib.stride_tricks.sliding_window_view(plain, span).all(axis=1)
        again = np.flatnonzero((distinct * AGAIN <= span) & said)
    senseless = {w for w in set(words) if _senseless(w)}
    if not senseless and not len(again):
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    return [places[k] for k, w in enumerate(words) if w in senseless] + [(places[k][0], places[k + span - 1][1]) for k in again]


class Judge:
    """Judges texts by fitted ratios."""

    def __init__(self, ratios: np.ndarray) -> None:
        # By order (slot, model): both models' ratios of an n-gram lie side by side.
        self.ratios = [np.ascontiguousarray(WEIGHTS[k] * ratios[:, k].T) for k in range(len(ORDERS))]
        self.unseen = [np.isnan(r[:, 0]) for r in self.ratios]
        for r in self.ratios:
            np.nan_to_num(r, copy=False)

    def coverage(self, text: str) -> float:
        """Share of the text's own content (navigation words aside) that is residue."""
        if "_" in text or "-" in text or "Error" in text or "Exception" in text:
            text = _ERROR_NAME.sub(" internal error code ", text)
        if _SOURCE_HINT.search(text):
            text = _SOURCE_LINE.sub(" fatal error on line ", text)
        items = [x.strip() for x in _SPLIT_ITEMS.split(_TRAILER.sub("", text)) if x.strip()]
        if len(items) >= 5 and sum(len(x.split()) <= 3 for x in items) >= 0.6 * len(items):
            # A list of navigation words: what is longer, or itself residue, is the content.
            scored = [(x, self._covered(x)) for x in items]
            content = [(len(x), c) for x, c in scored if len(x.split()) > 3 or (c >= 0.8 and len(x) >= 10)]
            if not content:
                return 0.0
            return sum(n * c for n, c in content) / sum(n for n, _ in content)
        return self._covered(" ".join(items))

    def _covered(self, text: str) -> float:
        folded = f" {_fold(text)} "
        cp = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(cp) - ORDERS[0] + 1
        if n < 4:
            return 0.0
        slots = _grams(cp, ORDERS[0])
        score, left = self.ratios[0][slots], np.flatnonzero(self.unseen[0][slots])
        for k in range(1, len(ORDERS)):
            if len(left):
                shorter = _grams(cp, ORDERS[k])[left]
                score[left] = self.ratios[k][shorter]
                left = left[self.unseen[k][shorter]]
        w = min(WINDOW, n)
        total = np.zeros((n + 1, 2))
        np.cumsum(score, axis=0, dtype=np.float64, out=total[1:])
        # The union: a record that is part notice and part filler is covered by both.
        hot = np.flatnonzero(((total[w:] - total[:-w]) > RATIO * w).any(axis=1))
        cover = np.zeros(n + 1, dtype=np.int32)
        cover[hot] += 1
        cover[hot + w] -= 1
        marked = np.cumsum(cover)[:n] > 0
        for a, z in meaningless(folded, folded=True):
            marked[min(a, n) : min(z, n)] = True
        return float(marked.mean())

    def is_residue(self, text: str | None) -> bool:
        """Whether the record is residue."""
        if not text or text.isspace():
            return False
        if ("{" in text or "[" in text or "<" in text or "%" in text or "__" in text or "@@" in text) and _FIELD.search(text):
            return True
        return self.coverage(text) >= COVERAGE


def read_prose(samples: DataFrame) -> np.ndarray:
    """(orders, slots): n-gram counts of all texts of the sample table; only the slots' sums reach the driver, as many as there are at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ORDERS), _SIZE))
        for b in batches:
            total += _all_counts(b.column(0).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype(np.int64))], names=["at", "n"])

    sums = samples.select("text").filter("text is not null").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(ORDERS) * _SIZE)
    total[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return total.reshape(len(ORDERS), _SIZE)


def flag(df: DataFrame, id_col: str, text_col: str, ratios: np.ndarray) -> DataFrame:
    """(rec_id): one row for each row that is residue; one pass, no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(ratios)
        for b in batches:
            hit = [judge.is_residue(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(hit, pa.bool_()))], names=["rec_id"])

    return spread(df.select(id_col, text_col).filter(F.col(text_col).isNotNull())).mapInArrow(run, f"rec_id {kind}")


def is_residue(text: Column, ratios: np.ndarray) -> Column:
    """Whether a text is residue; false for null."""

    @F.pandas_udf("boolean")
    def is_residue_udf(s: pd.Series) -> pd.Series:
        return s.map(Judge(ratios).is_residue).astype(bool)

    return is_residue_udf(text)


def exclude(df: DataFrame, text_col: str, ratios: np.ndarray) -> DataFrame:
    """The rows that are no residue, with all their columns."""
    return df.filter(~is_residue(F.col(text_col), ratios))
