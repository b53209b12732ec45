"""Language of texts and of the lines of mixed documents (problem 7).

Rank-order profiles: each language has the ranks of its most frequent n-grams
(of words padded with blanks, fit on the table of language samples, at most
``MAX_SAMPLES`` rows); a text's most frequent n-grams are ranked alike, and the
language with the least out-of-place distance is taken.  Confidence is the
relative gap to the second, in [0, 1].

A document is ``mul`` if lines that are sure and long enough are in different
languages, each with a fair share of the words.

Defined cases: null and blank texts have no language (null, confidence 0);
texts without any known n-gram likewise; ties go to the language that comes
first by code; repeats are judged alike; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import spread
from .residue import Judge

MAX_SAMPLES = 5_000
#: n-grams in a language's profile and the longest of them.
PROFILE, LONGEST = 1500, 5
#: Words a line needs, and its confidence, to speak for a language of its own; and that language's share of words.
LINE_WORDS, LINE_SURE, LINE_SHARE = 4, 0.3, 0.01
#: Below this confidence a label that names the second language is believed.
TRUST = 0.2
MIXED = "mul"

_MARKS = re.compile("[ً-ٰٟـ​-‏⁦-⁩﻿]+")
_NOISE = re.compile(r"https?://\S+|www\.\S+|\S+@\S+|@\w+|\[(?:URL|MENTION)\]", re.I)
_WORD = re.compile(r"[^\W_]+")
LINE_END = re.compile("\r\n|[\n\r  \x85\x0b\x0c]")
_MEMO = 300_000

# Spellings that name a language.
_CODES = {
    "arq_arab": "arq_arab",
    "arq_latn": "arq_latn",
    "fra": "fra",
    "fre": "fra",
    "fr": "fra",
    "ara": "ara",
    "ar": "ara",
    "arb": "ara",
    "eng": "eng",
    "en": "eng",
    "mul": "mul",
}


def named(label: str | None) -> str | None:
    """The code a label names whatever its case, blanks, hyphen, two letters or region; None if it names none."""
    if not label:
        return None
    key = re.sub(r"[\s\-]+", "_", label.strip().lower())
    return _CODES.get(key) or _CODES.get(key.split("_")[0] if re.fullmatch(r"[a-z]{2,3}_[a-z]{2}", key) else "")


def word_grams(word: str) -> list[str]:
    """n-grams of a padded word."""
    w = f"_{word}_"
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1) if w[i : i + n] != "_"]


def words_of(text: str) -> list[str]:
    """Lower-cased words with a letter, without marks, links, mentions and addresses."""
    if not text.isascii():
        text = _MARKS.sub("", text)
    if "@" in text or "/" in text or "[" in text or "www" in text:
        text = _NOISE.sub(" ", text)
    return [w for w in _WORD.findall(text.lower()) if not w.isdecimal()]


def fit(samples: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Profile of each language: its most frequent n-grams in order of rank."""
    counts: dict[str, Counter[str]] = {}
    for lang, text in samples:
        if lang and text:
            c = counts.setdefault(lang, Counter())
            for w in words_of(text):
                c.update(word_grams(w))
    return {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]] for lang, c in sorted(counts.items())}


class _Grams(dict):
    """Known n-grams of words as packed int32."""

    def __init__(self, index: dict[str, int]) -> None:
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> bytes:
        ids = [self.index[g] for g in word_grams(word[:64]) if g in self.index]
        for k in range(64, len(word), 64):
            ids += [self.index[g] for g in word_grams(word[k : k + 64]) if g in self.index]
        packed = np.asarray(ids, dtype=np.int32).tobytes()
        if len(self) >= _MEMO:
            self.clear()
        self[word] = packed
        return packed


class Identifier:
    """Languages by out-of-place distance."""

    def __init__(self, profiles: dict[str, list[str]]) -> None:
        self.langs = list(profiles)
        features = sorted({g for p in profiles.values() for g in p})
        index = {g: k for k, g in enumerate(features)}
        self.ranks = np.full((len(self.langs), len(features)), PROFILE, dtype=np.float32)
        for row, p in enumerate(profiles.values()):
            self.ranks[row, [index[g] for g in p]] = np.arange(len(p))
        # Ties of a text's counts are ranked by how frequent the n-gram is anywhere.
        self.usual = self.ranks.min(axis=0)
        self.grams = _Grams(index)
        self.second: str | None = None

    def counts(self, words: list[str]) -> np.ndarray:
        """Known n-grams of words with their counts: (ids, counts)."""
        ids = np.frombuffer(b"".join(map(self.grams.__getitem__, words)), dtype=np.int32)
        return np.unique(ids, return_counts=True)

    def of(self, ids: np.ndarray, n: np.ndarray) -> tuple[str | None, float]:
        """(language, confidence) of n-gram counts; the second language is left in ``second``."""
        self.second = None
        if not len(ids) or not self.langs:
            return None, 0.0
        order = np.argsort(self.usual[ids] - n * float(4 * PROFILE), kind="stable")[:PROFILE]
        top = ids[order]
        # Ranks are spread over the profile's scale, so that short texts compare with long ones.
        rank = np.arange(len(top), dtype=np.float32) * (PROFILE / max(len(top), PROFILE // 3))
        distance = np.abs(self.ranks[:, top] - rank).sum(axis=1)
        if len(distance) == 1:
            return self.langs[0], 1.0
        two = np.argsort(distance, kind="stable")[:2]
        best, second = distance[two[0]], distance[two[1]]
        self.second = self.langs[two[1]]
        return self.langs[two[0]], float((second - best) / second) if second > 0 else 0.0

    def text(self, text: str | None) -> tuple[str | None, float]:
        """(language, confidence) of a text taken as one."""
        return self.of(*self.counts(words_of(text))) if text else (None, 0.0)

    def document(self, text: str | None) -> tuple[str | None, float, list[tuple[str | None, float]]]:
        """(language or ``mul``, confidence, [(language, confidence) of each non-blank line])."""
        if not text or text.isspace():
            return None, 0.0, []
        lines = [x for x in LINE_END.split(text) if x.strip()]
        if len(lines) == 1:
            lang, sure = self.text(lines[0])
            return lang, sure, [(lang, sure)]
        words = [words_of(x) for x in lines]
        found = [self.of(*self.counts(w)) for w in words]
        votes: Counter[str] = Counter()
        for w, (lang, sure) in zip(words, found):
            if lang and len(w) >= LINE_WORDS and sure >= LINE_SURE:
                votes[lang] += len(w)
        total = sum(votes.values())
        several = [lang for lang, n in votes.items() if n >= LINE_SHARE * total]
        if len(several) > 1:
            return MIXED, float(np.mean([s for _, s in found])), found
        lang, sure = self.of(*self.counts([w for ws in words for w in ws]))
        return lang, sure, found


def read_samples(samples: DataFrame) -> list[tuple[str, str]]:
    """(lang, text) rows of the sample table, at most ``MAX_SAMPLES``."""
    return [(r[0], r[1]) for r in samples.select("lang", "text").filter("text is not null").orderBy("lang", "text").limit(MAX_SAMPLES).collect()]


def segments(df: DataFrame, id_col: str, text_col: str, profiles: dict[str, list[str]], lines: bool = True) -> DataFrame:
    """(rec_id, seg_no, lang, confidence): seg_no 0 for the text, 1, 2, ... for the non-blank lines of mixed documents.

    ``lines=False`` takes every text as one.  One pass, no shuffle.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = Identifier(profiles)
        for b in batches:
            took, seg, lang, sure = [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                whole, c, found = who.document(text) if lines else (*who.text(text), [])
                took.append(k), seg.append(0), lang.append(whole), sure.append(c)
                if whole == MIXED:
                    for no, (x, c) in enumerate(found, 1):
                        took.append(k), seg.append(no), lang.append(x), sure.append(c)
            yield _rows(b.column(0), took, seg, lang, sure)

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"rec_id {kind}, seg_no bigint, lang string, confidence double")


def relabelled(df: DataFrame, id_col: str, text_col: str, label_col: str, profiles: dict[str, list[str]], ratios: np.ndarray | None = None, lines: bool = True, least: int = 5) -> DataFrame:
    """``segments`` where they tell something: seg_no 0 only if the label names no or another language, and lines of mixed documents.

    Texts of fewer than ``least`` pieces between white space have no seg_no 0; with ``ratios``
    residue (problem 3) has no rows at all.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = Identifier(profiles)
        judge = Judge(ratios) if ratios is not None else None
        for b in batches:
            took, seg, lang, sure = [], [], [], []
            for k, (text, label) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if not text or text.isspace():
                    continue
                whole, c, found = who.document(text) if lines else (*who.text(text), [])
                said = named(label)
                wrong = whole is not None and said != whole and len(text.split(None, least)) >= least
                if wrong and whole != MIXED and c < TRUST and said is not None and said == who.second:
                    wrong = False
                if not wrong and whole != MIXED:
                    continue
                if judge is not None and judge.is_residue(text):
                    continue
                if wrong:
                    took.append(k), seg.append(0), lang.append(whole), sure.append(c)
                if whole == MIXED:
                    for no, (x, c) in enumerate(found, 1):
                        took.append(k), seg.append(no), lang.append(x), sure.append(c)
            yield _rows(b.column(0), took, seg, lang, sure)

    return spread(df.select(id_col, text_col, label_col)).mapInArrow(run, f"rec_id {kind}, seg_no bigint, lang string, confidence double")


def _rows(ids: pa.Array, took: list, seg: list, lang: list, sure: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(took, pa.int64())), pa.array(seg, pa.int64()), pa.array(lang, pa.string()), pa.array(sure, pa.float64())],
        names=["rec_id", "seg_no", "lang", "confidence"],
    )


def share_by_language(found: DataFrame) -> DataFrame:
    """(lang, texts, mean_confidence) of ``segments`` rows with seg_no 0."""
    return found.filter("seg_no = 0").groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.avg("confidence").alias("mean_confidence"))
