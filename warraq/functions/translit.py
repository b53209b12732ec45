"""Arabic script to Latin by weighted tables: the likeliest rendering, or one drawn by hash (retry-safe)."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import translit_tables as tables

Choice = tuple[tuple[str, float], ...]
_PARTS = re.compile(r"(\s+|[^\w؀-ۿ]+)")
_ARABIC = re.compile(r"[؀-ۿ]+\Z")


def likeliest(options: Choice, key: str) -> str:
    """First of the heaviest renderings."""
    return max(options, key=lambda o: o[1])[0]


def drawn(seed: int) -> Callable[[Choice, str], str]:
    """A rendering by weight, the uniform number being a hash of the place."""

    def pick(options: Choice, key: str) -> str:
        u = xxhash.xxh3_64_intdigest(key, seed) / 2**64 * sum(w for _, w in options)
        for r, w in options:
            u -= w
            if u < 0:
                return r
        return options[-1][0]

    return pick


def _position(word: str, i: int) -> str:
    if i == 0:
        return "first"
    if i == len(word) - 1:
        return "last"
    return "between" if word[i - 1] not in tables.VOWELS and word[i + 1] not in tables.VOWELS else "other"


def word(w: str, pick: Callable[[Choice, str], str], key: str = "") -> str:
    """Rendering of one word: whole words by the word table, else the article, the ligature, weak letters by position, letters."""
    if w in tables.WORDS:
        return pick(tables.WORDS[w], key)
    out, i = [], 0
    if len(w) > 2 and w[:2] == "ال":
        out.append(pick(tables.ARTICLE, f"{key}:article"))
        i = 2
    while i < len(w):
        at = f"{key}:{i}"
        if w[i : i + 2] == "لا":
            out.append(pick(tables.LETTERS["لا"], at))
            i += 2
            continue
        options = tables.WEAK[w[i]][_position(w, i)] if w[i] in tables.WEAK else tables.LETTERS.get(w[i], ((w[i], 1.0),))
        out.append(pick(options, at))
        i += 1
    return "".join(out)


def text(t: str | None, pick: Callable[[Choice, str], str] = likeliest, key: str = "") -> str | None:
    """Rendering of a text; only words wholly in Arabic script change."""
    if t is None:
        return None
    return "".join(word(p, pick, f"{key}:{k}") if _ARABIC.match(p) else p for k, p in enumerate(_PARTS.split(t)))


def transliterate(c: Column, key: Column | None = None, seed: int | None = None) -> Column:
    """Likeliest renderings, or drawn ones with ``seed`` and a row key."""
    if seed is None:

        @F.pandas_udf("string")
        def argmax_udf(s: pd.Series) -> pd.Series:
            return s.map(text)

        return argmax_udf(c)

    @F.pandas_udf("string")
    def drawn_udf(s: pd.Series, k: pd.Series) -> pd.Series:
        pick = drawn(seed)
        return pd.Series([text(t, pick, str(i)) for t, i in zip(s, k)])

    return drawn_udf(c, key)
