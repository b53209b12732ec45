"""Public tokenizers as operators: encode, decode, pieces, fertility, compare.

A worker loads a tokenizer once.  Tokenizers are never trained here; their
folder is a parameter.  Null texts are left out, empty ones have no pieces.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

FOLDER = os.environ.get("WARRAQ_TOKENIZERS", "/opt/tokenizers")
NAMES = ("byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k")
# Fixed value: the published split pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Codec = tuple[Callable[[str], list[int]], Callable[[list[int]], str]]
_LOADED: dict[tuple[str, str], Codec] = {}


def load(name: str, folder: str = FOLDER) -> Codec:
    """(encode, decode) of a public tokenizer."""
    key = (name, folder)
    if key not in _LOADED:
        path = next(p for p in (os.path.join(folder, f"{name}{x}") for x in (".tiktoken", ".model", ".json")) if os.path.exists(p))
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            t = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _LOADED[key] = (t.encode_ordinary, t.decode)
        elif path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[key] = (sp.encode, sp.decode)
        else:
            from tokenizers import Tokenizer

            tk = Tokenizer.from_file(path)
            tk.encode_special_tokens = True
            _LOADED[key] = (lambda s: tk.encode(s, add_special_tokens=False).ids, tk.decode)
    return _LOADED[key]


def compare(df: DataFrame, text_col: str, names: tuple[str, ...] = NAMES, folder: str = FOLDER) -> DataFrame:
    """(tokenizer, texts, words, pieces, fertility, compression, mismatches): one pass over the texts for all tokenizers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name in names:
                encode, decode = load(name, folder)
                pieces = words = chars = bad = 0
                for t in pdf["t"]:
                    ids = encode(t)
                    pieces += len(ids)
                    words += len(t.split())
                    chars += len(t)
                    bad += decode(ids) != t
                rows.append((name, len(pdf), words, chars, pieces, bad))
            yield pd.DataFrame(rows, columns=["tokenizer", "texts", "words", "chars", "pieces", "mismatches"])

    x = spread(df.select(F.col(text_col).alias("t")).filter("t is not null"))
    parts = x.mapInPandas(run, "tokenizer string, texts bigint, words bigint, chars bigint, pieces bigint, mismatches bigint")
    g = parts.groupBy("tokenizer").agg(*[F.sum(c).alias(c) for c in ("texts", "words", "chars", "pieces", "mismatches")])
    return g.select("tokenizer", "texts", "words", "pieces", F.round(F.col("pieces") / F.col("words"), 6).alias("fertility"), F.round(F.col("pieces") / (F.col("chars") + F.col("words")), 6).alias("compression"), "mismatches")


def discover(folder: str = FOLDER) -> list[tuple[str, str]]:
    """(name, kind) of the tokenizers in a folder, sorted."""
    kinds = {".tiktoken": "ranks", ".model": "pieces", ".json": "json"}
    return sorted({(p.stem, kinds[p.suffix]) for p in Path(folder).iterdir() if p.suffix in kinds})


def _over(c: Column, type_: str, make: Callable[[], Callable]) -> Column:
    @F.pandas_udf(type_)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for s in batches:
            yield pd.Series([None if x is None else f(x) for x in s], dtype=object)

    return udf(c)


def ids(text: Column, name: str, folder: str = FOLDER) -> Column:
    """Ids of a text; null for null, none for an empty text."""
    return _over(text, "array<int>", lambda: load(name, folder)[0])


def text_of(ids: Column, name: str, folder: str = FOLDER) -> Column:
    """Text of an array of ids."""
    return _over(ids, "string", lambda: lambda x, d=load(name, folder)[1]: d([int(i) for i in x]))


def piece_count(text: Column, name: str, folder: str = FOLDER) -> Column:
    """Number of pieces of a text."""
    return _over(text, "int", lambda: lambda x, e=load(name, folder)[0]: len(e(x)))


def pieces(text: Column, name: str, folder: str = FOLDER) -> Column:
    """Pieces of a text as they are written in the vocabulary; bytes that are no text by themselves as ``<0xHH>``."""

    def make() -> Callable[[str], list[str]]:
        path = next(p for p in (os.path.join(folder, f"{name}{x}") for x in (".tiktoken", ".model", ".json")) if os.path.exists(p))
        if path.endswith(".model"):
            import sentencepiece

            return lambda t, sp=sentencepiece.SentencePieceProcessor(model_file=path): sp.encode(t, out_type=str)
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tk = Tokenizer.from_file(path)
            tk.encode_special_tokens = True
            return lambda t: tk.encode(t, add_special_tokens=False).tokens
        with open(path, "rb") as f:
            entries = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        encode = load(name, folder)[0]

        def shown(raw: bytes) -> list[str]:
            try:
                return [raw.decode()]
            except UnicodeDecodeError:
                return [f"<0x{x:02X}>" for x in raw]

        return lambda t: [p for i in encode(t) for p in shown(entries[i])]

    return _over(text, "array<string>", make)


_RUN = re.compile("(?:<0x[0-9A-Fa-f]{2}>)+")


def joined(pieces: Column) -> Column:
    """Text of pieces: runs of ``<0xHH>`` pieces are UTF-8 bytes, broken ones replaced; U+2581 is a blank; stripped."""

    def join(parts: list[str]) -> str:
        whole, run = [], []
        for p in [*parts, ""]:
            if _RUN.fullmatch(p):
                run.append(p[3:5])
                continue
            if run:
                whole.append(bytes.fromhex("".join(run)).decode("utf-8", "replace"))
                run = []
            whole.append(p)
        return "".join(whole).replace("\u2581", " ").strip()

    return _over(pieces, "string", lambda: join)


NEWLINE = "[NEWLINE]"


def keep_newlines(text: Column) -> Column:
    """Line feeds as a word, for tokenizers that lose them."""
    return F.replace(text, F.lit("\n"), F.lit(f" {NEWLINE} "))


def restore_newlines(text: Column) -> Column:
    """The inverse of ``keep_newlines``, where either blank may have got lost."""
    return F.regexp_replace(text, r"\s?\[NEWLINE\]\s?", "\n")


def word_fertility(words: DataFrame, names: tuple[str, ...] = NAMES, folder: str = FOLDER) -> DataFrame:
    """(tokenizer, script, words, pieces, fertility) of words (word, script, n): a distinct word is encoded once; ``ALL`` is of all scripts."""
    distinct = words.groupBy("word", "script").agg(F.sum("n").alias("n"))
    x = spread(distinct).select("script", "n", *[piece_count(F.col("word"), t, folder).alias(t) for t in names])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.col(t).alias("pieces")) for t in names])).alias("x")
    sums = x.select("script", "n", each).groupBy("x.tokenizer", "script").agg(F.sum("n").alias("words"), F.sum(F.col("n") * F.col("x.pieces")).alias("pieces"))
    every = sums.groupBy("tokenizer").agg(F.sum("words").alias("words"), F.sum("pieces").alias("pieces")).withColumn("script", F.lit("ALL"))
    return sums.unionByName(every.select(sums.columns)).withColumn("fertility", F.round(F.col("pieces") / F.col("words"), 6))
