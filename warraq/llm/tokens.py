"""Exact token ids (problem 8) and token budgets (problem 5).

Null and empty texts have no ids and count 0.  Text is read whole; a text that
looks like a special token is ordinary text.  Extra columns are ignored, so
their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import spread
from . import bpe

DEFAULT = "byte_bpe_50k"


def encode(df: DataFrame, id_col: str, text_col: str, tokenizer: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """One row ``(id, ids)`` for every row, in one pass without a shuffle.

    Repeated ids stay repeated; a null id stays null.  Ids go from the worker's flat buffer
    straight into an Arrow list column.
    """
    path = bpe.rank_path(tokenizer, folder)
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets = bpe.encode_batch(path, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], names=[id_col, "ids"])

    return spread(df.select(id_col, text_col)).mapInArrow(run, schema)


def token_count(text: Column, tokenizer: str = DEFAULT, folder: str | None = None) -> Column:
    """Exact number of ids of a text; 0 for null and empty."""
    path = bpe.rank_path(tokenizer, folder)

    @F.pandas_udf("bigint")
    def token_count_udf(s: pd.Series) -> pd.Series:
        return pd.Series(list(map(bpe.counter(path).count, s)), dtype="int64")

    return token_count_udf(text)


def counted(df: DataFrame, keys: list[str], text_col: str, tokenizer: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """Rows, null texts, empty texts, characters and tokens by ``keys``, null keys being groups of their own.

    Counts are pre-aggregated before the one shuffle, which carries a row per group and task.
    """
    slim = spread(df.select(*keys, F.col(text_col).alias("__text")))
    return (
        slim.select(*keys, "__text", token_count(F.col("__text"), tokenizer, folder).alias("__n"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count_if(F.col("__text").isNull()).alias("null_texts"),
            F.count_if(F.col("__text") == "").alias("empty_texts"),
            F.coalesce(F.sum(F.length("__text")), F.lit(0)).cast("bigint").alias("chars"),
            F.sum("__n").alias("tokens"),
        )
    )


def cube(counts: DataFrame, keys: list[str]) -> DataFrame:
    """All roll-ups of ``counted`` groups; ``level`` names the keys a row is grouped by, so that a null key is no total.

    The cube runs over the groups, not over the rows.
    """
    level = F.concat_ws(",", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys])
    sums = [F.sum(c).alias(c) for c in ("records", "null_texts", "empty_texts", "chars", "tokens")]
    return counts.cube(*keys).agg(level.alias("level"), *sums)


def token_budget(df: DataFrame, keys: list[str], text_col: str = "text", tokenizer: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """Cube of token totals over ``keys``; an empty table gives only what the grand total gives: nothing or one row of nulls dropped."""
    return cube(counted(df, keys, text_col, tokenizer, folder), keys).filter(F.col("records").isNotNull())
