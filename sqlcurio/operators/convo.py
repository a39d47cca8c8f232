"""Conversations and schemas within token budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sqlcurio.functions.prompts import estimate_tokens


def conversation_tokens(turns: DataFrame) -> DataFrame:
    """Messages and estimated tokens of each conversation: a quarter of the characters, a blank per message."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("messages"), F.floor(F.sum(F.length(F.coalesce("text", F.lit(""))) + 1) / 4).cast("long").alias("tokens"))


def truncate(turns: DataFrame, budget: int) -> DataFrame:
    """System messages and the newest others that fit ``budget`` tokens with them, in their old order.

    Newest to oldest, the first message that does not fit ends the history.
    """
    own = Window.partitionBy("conv_id")
    system = F.col("role") == "system"
    t = turns.withColumn("_t", estimate_tokens(F.col("text")))
    t = t.withColumn("_s", F.sum(F.when(system, F.col("_t")).otherwise(0)).over(own))
    newest = own.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("_used", F.sum(F.when(system, 0).otherwise(F.col("_t"))).over(newest))
    return t.where(system | (F.col("_used") + F.col("_s") <= budget)).select(turns.columns)


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    own = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= n).select(turns.columns)


def _chunks(sizes: list[int], limit: int, base: int, chunk: int = 0, used: int = 0) -> tuple[list[int], int, int]:
    """Chunk number of each size, and the number and fill of the last chunk, from where an earlier call left off."""
    at = []
    for n in sizes:
        if used > 0 and used + n + base > limit:
            chunk, used = chunk + 1, 0
        used += n
        at.append(chunk)
    return at, chunk, used


def next_fit(sizes: Column, limit: int, base: int = 0) -> Column:
    """Chunk number (from 0) of each size, in order: a new chunk where the current one and ``base`` would pass ``limit``.

    Takes time in proportion to the sizes. A null array gives null, a null size is 0. As a Python
    function it can't stand within a lambda of another expression.
    """

    @F.pandas_udf("array<int>")
    def fit(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else _chunks([0 if x is None or x != x else int(x) for x in a], limit, base)[0])

    return fit(F.transform(sizes, lambda x: x.cast("long")))


def chunk_schemas(tables: DataFrame, key: str, order: str, text: str, limit: int = 4000, base: int = 0) -> DataFrame:
    """(key, order, tokens, chunk): the tables of each schema packed in order, next fit.

    Texts become token counts before the shuffle. Tables stream through a task sorted by (key, order,
    tokens); only the fill of the open chunk is held, so a schema may have any number of tables. A null
    key is a schema of its own.
    """
    sized = tables.select(F.col(key), F.col(order), estimate_tokens(F.col(text)).alias("tokens"))
    ordered = sized.repartition(key).sortWithinPartitions(key, order, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, chunk, used = None, 0, 0  # the open schema, in an array of one, and its open chunk
        for b in batches:
            keys, tokens, at = b.column(0), b.column(2).to_pylist(), []
            ends = [*(pc.run_end_encode(keys).run_ends.to_pylist() if b.num_rows else [])]
            for start, end in zip([0, *ends], ends, strict=False):
                own = keys.slice(start, 1)
                if schema is None or not own.equals(schema):
                    schema, chunk, used = own, 0, 0
                part, chunk, used = _chunks(tokens[start:end], limit, base, chunk, used)
                at += part
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "chunk"])

    return ordered.mapInArrow(run, StructType([*sized.schema.fields, StructField("chunk", IntegerType())]))


def large_schemas(tables: DataFrame, key: str, text: str, threshold: int = 6000) -> DataFrame:
    """Tokens of each schema and whether they pass the threshold."""
    n = tables.groupBy(key).agg(F.sum(estimate_tokens(F.col(text))).alias("tokens"))
    return n.withColumn("is_large", F.col("tokens") > threshold)
