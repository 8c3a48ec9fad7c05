"""Integer ids for the distinct values of columns of any variety, without a list of values on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallycast.session import scratch_path

_ROW_BITS = 33  # of monotonically_increasing_id: the partition stands above them


def dense_ids(values: DataFrame, columns: list[str], name: str = "code") -> DataFrame:
    """The distinct non-null rows of ``columns`` with ids 0, 1, 2, ... in their sort order, as a written table.

    The values are dealt out by range and sorted inside each range; an id is the number of values in earlier ranges plus the
    place in its own. Only the counts of the ranges, one number per shuffle partition, are brought together.
    """
    spark = values.sparkSession
    known = values.select(*columns).dropna().distinct()
    placed = known.repartitionByRange(*columns).sortWithinPartitions(*columns)
    path = scratch_path(spark, "ranges")
    placed.withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    ranged = spark.read.parquet(path).select(
        *columns, F.shiftright("__at", _ROW_BITS).cast("int").alias("__range"), F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1).alias("__place"))
    offsets, before = {}, 0
    for part, size in ranged.groupBy("__range").count().orderBy("__range").collect():
        offsets[part] = before
        before += size
    if not offsets:
        return ranged.select(*columns, F.lit(0).cast("long").alias(name))
    starts = spark.createDataFrame(list(offsets.items()), "__range int, __start long")
    # One row per shuffle partition, so this side has a proven size.
    return ranged.join(F.broadcast(starts), "__range").select(*columns, (F.col("__start") + F.col("__place")).alias(name))


def encode_ids(df: DataFrame, ids: DataFrame, columns: list[str], name: str = "code", unknown: int | None = None) -> DataFrame:
    """``df`` with the id of its ``columns``. Values without an id, and nulls, get ``unknown``; by default the next free id."""
    if unknown is None:
        unknown = ids.agg(F.coalesce(F.max(name) + 1, F.lit(0))).scalar()
    else:
        unknown = F.lit(unknown)
    return df.join(ids, columns, "left").withColumn(name, F.coalesce(F.col(name), unknown))
