"""The two cleaning pipelines, as Column expressions and as Python functions.

Both forms apply the same ordered rules.  The Column form keeps everything but
NFKC in the JVM; the Python form serves operators that are in Python anyway
(signatures), so that a row crosses the boundary once.  A null text, or one
with fewer than two residual letters after cleaning, gives null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

_EM = "\U0001f300-\U0001f5ff\U0001f600-\U0001f64f\U0001f680-\U0001f6ff\U0001f900-\U0001f9ff\U0001fa00-\U0001faff\U0001f1e6-\U0001f1ff\u2600-\u27bf"
_G = f"[{_EM}]\ufe0f?(?:\u200d[{_EM}]\ufe0f?)*"
MIN_RESIDUAL = 2

Rule = tuple[re.Pattern[str], str]


def _rule(pattern: str, to: str, flags: int = 0) -> Rule:
    return re.compile(pattern, flags), to


# The rules in the order that the result depends on.
_TACHKIL = _rule("[\u064b-\u065f\u0670]+", "")
_URL = _rule(r"(?:https?://\S+|www\.\S+)", " [URL] ", re.I)
_COMMON: tuple[Rule, ...] = (
    _rule(r"([^\W\d_])\1{2,}", r"\1\1"),
    _rule(r"\.{2,}", "..."),
    _rule("([!?\u061f,\u060c])\\1{2,}", r"\1\1"),
    _rule(f"({_G})({_G})(?:{_G})+", r"\1\2"),
    _rule(r"[ \t]{2,}", " "),
    _rule(r"\n{3,}", "\n\n"),
)
COMMENT_RULES: tuple[Rule, ...] = (
    _rule("[\u200b\u200c\u200e\u200f\u2066-\u2069\ufeff]+", ""),
    _rule(f"(?<![{_EM}])\u200d|\u200d(?![{_EM}])", ""),
    _TACHKIL,
    _rule(r"@[\w.]+", " [MENTION] "),
    _URL,
    _rule(r"\b\d{1,2}:\d{2}(?::\d{2})?\b", " "),
    *_COMMON,
)
POST_RULES: tuple[Rule, ...] = (
    _rule("أكبر تواجد بالمنتدى كان.*", "", re.S),
    _rule(r"اقتباس:\s*\nالمشاركة الأصلية كتبت بواسطة\s+\S+", " "),
    _rule(r"\[/?(?!URL\])[a-zA-Z]+(?:=[^\]]*)?\s*\]", " "),
    _rule("\u0640+", ""),
    _TACHKIL,
    _URL,
    *_COMMON,
)
_WORDISH = re.compile(f"(?![{_EM}])[\\w\u0600-\u06ff]")


# Bits by which a rule can be skipped for a text that holds nothing it could match.
_INV, _ZWJ, _TAC, _AT, _COLON, _DOT, _W, _PUNCT, _EMO, _BLANK, _NL, _BRACKET, _TATWEEL, _WIDGET = (1 << k for k in range(14))
_RUN3, _DOT2, _BLANK2 = 1 << 14, 1 << 15, 1 << 16
_ALL = (1 << 17) - 1


def _bit_table() -> np.ndarray:
    table = np.zeros(0x20000, dtype=np.int32)
    for bit, chars in (
        (_INV, "\u200b\u200c\u200e\u200f\u2066\u2067\u2068\u2069\ufeff"),
        (_ZWJ, "\u200d"),
        (_TAC, "".join(map(chr, [*range(0x64B, 0x660), 0x670]))),
        (_AT, "@"),
        (_COLON, ":"),
        (_DOT, "."),
        (_W, "wW"),
        (_PUNCT, "!?\u061f,\u060c"),
        (_BLANK, " \t"),
        (_NL, "\n"),
        (_BRACKET, "["),
        (_TATWEEL, "\u0640"),
        (_WIDGET, "\u0623"),
    ):
        for ch in chars:
            table[ord(ch)] |= bit
    for a, b in ((0x1F300, 0x1F6FF), (0x1F900, 0x1F9FF), (0x1FA00, 0x1FAFF), (0x1F1E6, 0x1F1FF), (0x2600, 0x27BF)):
        table[a : b + 1] |= _EMO
    return table


_TABLE = _bit_table()


def text_bits(texts: list[str]) -> np.ndarray:
    """Per text, which characters and repeats it holds (one vector pass over the batch)."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out = np.zeros(len(texts), dtype=np.int32)
    some = np.flatnonzero(lens)
    if not len(some):
        return out
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bits = _TABLE[np.minimum(cp, 0x1FFFF)]
    same = np.zeros(len(cp), dtype=bool)
    same[:-1] = cp[1:] == cp[:-1]
    run3 = same.copy()
    run3[:-1] &= same[1:]
    run3[-1] = False
    bits[run3] |= _RUN3
    bits[same & ((bits & _DOT) > 0)] |= _DOT2
    blank = (bits & _BLANK) > 0
    blank[:-1] &= blank[1:]
    bits[blank] |= _BLANK2
    starts = np.concatenate(([0], np.cumsum(lens[some])[:-1]))
    out[some] = np.bitwise_or.reduceat(bits, starts)
    return out


# What a text must hold for the rule at the same place to be tried.
_COMMON_NEEDS = (_RUN3, _DOT2, _RUN3 | _PUNCT, _EMO, _BLANK2, _RUN3 | _NL)
_COMMENT_NEEDS = (_INV, _ZWJ, _TAC, _AT, _COLON | _W, _COLON, *_COMMON_NEEDS)
_POST_NEEDS = (_WIDGET, _COLON, _BRACKET, _TATWEEL, _TAC, _COLON | _W, *_COMMON_NEEDS)


def _apply(text: str | None, rules: tuple[Rule, ...], needs: tuple[int, ...], bits: int) -> str | None:
    if text is None:
        return None
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
        bits = _ALL
    for (pattern, to), need in zip(rules, needs):
        if bits & need:
            text, changed = pattern.subn(to, text)
            if changed:
                bits |= _RUN3 | _DOT2 | _BLANK2
    text = text.strip()
    residual = 0
    for _ in _WORDISH.finditer(text):
        residual += 1
        if residual >= MIN_RESIDUAL:
            return text
    return None


def clean_comment_texts(texts: list[str | None]) -> list[str | None]:
    """Comment pipeline on a batch; rules that cannot match a text are not tried on it."""
    bits = text_bits([t or "" for t in texts]).tolist()
    return [_apply(t, COMMENT_RULES, _COMMENT_NEEDS, b) for t, b in zip(texts, bits)]


def clean_post_texts(texts: list[str | None]) -> list[str | None]:
    """Forum pipeline on a batch; rules that cannot match a text are not tried on it."""
    bits = text_bits([t or "" for t in texts]).tolist()
    return [_apply(t, POST_RULES, _POST_NEEDS, b) for t, b in zip(texts, bits)]


def clean_comment_text(text: str | None) -> str | None:
    """Comment pipeline on one text."""
    return _apply(text, COMMENT_RULES, _COMMENT_NEEDS, _ALL)


def clean_post_text(text: str | None) -> str | None:
    """Forum pipeline on one text."""
    return _apply(text, POST_RULES, _POST_NEEDS, _ALL)


def _nfkc_series(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() or unicodedata.is_normalized("NFKC", x) else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """NFKC normal form: the one rule for which Spark has no expression."""

    @F.pandas_udf("string")
    def nfkc_udf(s: pd.Series) -> pd.Series:
        return _nfkc_series(s)

    return nfkc_udf(c)


def _chain(c: Column, steps: tuple[Callable[[Column], Column], ...]) -> Column:
    for step in steps:
        c = step(c)
    return c


_TAIL = (T.collapse_elongation, T.collapse_punctuation, T.collapse_emoji, T.normalize_whitespace)
COMMENT_STEPS = (T.strip_invisible, T.strip_tachkil, T.replace_mentions, T.replace_urls, T.strip_clock_times, *_TAIL)
POST_STEPS = (T.strip_widget, T.strip_quote_header, T.strip_bbcode, T.strip_tatweel, T.strip_tachkil, T.replace_urls, *_TAIL)


def near_empty_to_null(c: Column) -> Column:
    """Null for a text with fewer than two residual letters."""
    return F.when(T.residual_letters(c) >= MIN_RESIDUAL, c)


def clean_comment(c: Column, normalize: bool = True) -> Column:
    """Comment pipeline; ``normalize=False`` for texts already in NFKC."""
    return near_empty_to_null(_chain(nfkc(c) if normalize else c, COMMENT_STEPS))


def clean_post(c: Column, normalize: bool = True) -> Column:
    """Forum pipeline; ``normalize=False`` for texts already in NFKC."""
    return near_empty_to_null(_chain(nfkc(c) if normalize else c, POST_STEPS))


def cleaned(c: Column, post: bool = False) -> Column:
    """Either pipeline as one Arrow UDF: a row crosses to Python once, as it must for NFKC, and each rule runs once.

    Declared non-deterministic only so that a filter on the result is not pushed below it and the
    pipeline run again; the result depends on the text alone.
    """

    def cleaned_udf(s: pd.Series) -> pd.Series:
        return pd.Series((clean_post_texts if post else clean_comment_texts)(s.tolist()), dtype=object)

    return F.pandas_udf(cleaned_udf, "string").asNondeterministic()(c)
