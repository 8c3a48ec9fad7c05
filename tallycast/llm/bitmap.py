"""A bitmap of hashed ids as a table of fixed size: a pre-filter that may be broadcast at any input size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS = 24


def _bit(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << bits))


def bitmap(ids: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """``[slot, word]``: at most ``2 ** (bits - 6)`` rows, whatever the number of ids."""
    bit = _bit(column, bits)
    return ids.select(F.floor(bit / 64).cast("int").alias("slot"), F.expr("1L").alias("one"), (bit % 64).cast("int").alias("at")).groupBy(
        "slot").agg(F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("at"))).alias("word"))


def marked(df: DataFrame, filters: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """``df`` with a boolean ``marked``: false means certainly not among the ids, also for a null id."""
    bit = _bit(column, bits)
    joined = df.withColumn("__slot", F.floor(bit / 64).cast("int")).join(
        F.broadcast(filters.select(F.col("slot").alias("__slot"), F.col("word").alias("__word"))), "__slot", "left")
    hit = F.expr("(shiftright(__word, cast(pmod(xxhash64(`%s`), %d) %% 64 as int)) & 1L) = 1L" % (column, 1 << bits))
    return joined.withColumn("marked", F.coalesce(hit & F.col(column).isNotNull(), F.lit(False))).drop("__slot", "__word")
