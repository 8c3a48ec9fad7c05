"""Repeatable stratified samples of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallycast.session import use_checkpoints


def stratified_sample(ids_cats: DataFrame, n: int | Column, seed: int = 42, stratum: str = "cat_id") -> DataFrame:
    """About ``n`` series, each stratum in proportion to its size, in an order fixed by md5(id + seed).

    The rank inside a stratum is exact, but no task ever sorts a whole stratum: the first three hex
    digits of the hash split it into 4096 slices in rank order, slice sizes give each slice its offset,
    and rows are ranked within their slice only. The series list is checkpointed because counting,
    slicing and ranking each read it; the panel behind it is read once.
    """
    use_checkpoints(ids_cats.sparkSession)
    size = F.lit(n) if isinstance(n, int) else n
    series = (
        ids_cats.select("id", stratum)
        .distinct()
        .withColumn("pick", F.md5(F.concat("id", F.lit(str(seed))).cast("binary")))
        .withColumn("slice", F.substring("pick", 1, 3))
        # One key for stratum and slice: rows can then only be spread by both, never by the stratum alone.
        .withColumn("slot", F.concat("slice", stratum))
        .checkpoint()
    )
    slices = series.groupBy("slot", "slice", stratum).agg(F.count(F.lit(1)).alias("in_slice"))
    total = slices.agg(F.sum("in_slice")).scalar()
    in_stratum = W.partitionBy(stratum)
    before = in_stratum.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        slices.withColumn("offset", F.coalesce(F.sum("in_slice").over(before), F.lit(0)))
        .withColumn("stratum_size", F.sum("in_slice").over(in_stratum))
        .withColumn("total", total)
        .withColumn("share", F.least(F.lit(1.0), size / F.col("total")))
        .withColumn("quota", F.bround(F.col("share") * F.col("stratum_size")))
        .where(F.col("offset") < F.col("quota"))
        .select("slot", "offset", "quota")
    )
    in_slot = W.partitionBy("slot").orderBy("pick", "id")
    return (
        series.join(offsets, "slot")
        .withColumn("place", F.col("offset") + F.row_number().over(in_slot))
        .where(F.col("place") <= F.col("quota"))
        .select("id", stratum)
    )
