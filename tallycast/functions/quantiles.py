"""Quantile expressions: per-series nearest rank, exact global quantile, and repair of forecast quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tallycast.functions.names import QUANTILES


def nearest_rank(n: Column, level: float) -> Column:
    """1-based rank of the nearest-rank quantile among ``n`` sorted values."""
    return F.floor((n - 1) * F.lit(level) + F.lit(0.5)).cast("int") + 1


def nearest_of_sorted(values: Column, level: float) -> Column:
    """Nearest-rank quantile of a sorted array, NULL when it is empty."""
    return F.try_element_at(values, F.greatest(nearest_rank(F.size(values), level), F.lit(1)))


def exact_quantile(df: DataFrame, value: str, level: float, accuracy: int = 100_000) -> DataFrame:
    """One row ``threshold``: the exact nearest-rank quantile of a column over all rows, NULL without values.

    The number of values gives the wanted rank. A sketch brackets the ranks next to it by its own error, equal
    values are counted map-side, and only the distinct values inside the bracket are ranked. Should the rank fall outside the
    bracket, the query fails instead of giving a neighbour. Neither the driver nor one task ever sees the whole column.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    n = known.agg(F.count(F.lit(1))).first()[0]
    if n == 0:
        return known.agg(F.min("v").alias("threshold"))
    rank = math.floor((n - 1) * level + 0.5) + 1
    error = 2.0 / accuracy
    low, high = max((rank - 1) / n - error, 0.0), min((rank + 1) / n + error, 1.0)
    ends = known.agg(F.percentile_approx("v", [low, high], accuracy).alias("ends"))
    low_value, high_value = ends.select(F.col("ends")[0]).scalar(), ends.select(F.col("ends")[1]).scalar()
    counts = known.where(F.col("v") <= high_value).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    below = counts.where(F.col("v") < low_value).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("b")).scalar()
    inside = counts.where(F.col("v") >= low_value).withColumn("reach", F.sum("c").over(W.orderBy("v")))
    found = inside.agg(
        F.min(F.when(F.col("reach") + below >= rank, F.col("v"))).alias("threshold"), F.first(below).alias("below"))
    missed = F.col("threshold").isNull() | (F.col("below") >= rank)
    return found.select(F.when(missed, F.raise_error(F.lit("the rank lies outside the bracket"))).otherwise(F.col("threshold")).alias("threshold"))


def repair_quantiles(df: DataFrame) -> DataFrame:
    """Clip the forecast quantiles at zero and make them monotone around the median."""
    zero = F.lit(0.0)
    clipped = df.withColumns({q: F.greatest(F.col(q).cast("double"), zero) for q in QUANTILES})
    return clipped.withColumns(
        {"q10": F.least("q10", "q50"), "q90": F.greatest("q90", "q50")}
    )
