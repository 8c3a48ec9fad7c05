"""Reshaping forecasts: wide submission form, future covariate rows, array forecasts, blending."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallycast.functions.names import EVENT_COLUMNS, HORIZON, ID_COLUMNS


def forecast_wide(forecast: DataFrame, blocks: dict[int, str], horizon: int = HORIZON) -> DataFrame:
    """One row per series and block with the median of each day as F1, F2, ...

    ``blocks`` names the forecast origins to show. The name ends the id; an id that already ends in a
    block name changes it. All blocks share one aggregation.
    """
    names = "|".join(sorted({*blocks.values(), "evaluation", "validation"}))
    series = F.regexp_replace("id", f"_({names})$", "")
    block = F.lit(None).cast("string")
    for origin, name in blocks.items():
        block = F.when(F.col("origin") == origin, F.lit(name)).otherwise(block)
    shown = forecast.where(F.col("origin").isin(*blocks)).select(
        "origin", F.concat_ws("_", series, block).alias("id"), (F.col("d_num") - F.col("origin")).alias("step"), "q50"
    )
    steps = [F.max(F.when(F.col("step") == i, F.col("q50"))).alias(f"F{i}") for i in range(1, horizon + 1)]
    return shown.groupBy("origin", "id").agg(*steps).drop("origin")


def future_rows(panel: DataFrame, calendar: DataFrame, prices: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """Rows after the data with everything known in advance: series attributes, calendar and price.

    Sales are NULL there, so they can never enter an aggregate.
    """
    days = F.sequence(F.lit(first_day), F.lit(last_day))
    grid = (
        panel.select(*ID_COLUMNS)
        .distinct()
        .select(*ID_COLUMNS, F.explode(days).alias("d_num"))
        .withColumn("d", F.concat(F.lit("d_"), F.col("d_num").cast("string")))
    )
    covariates = calendar.fillna("none", EVENT_COLUMNS)
    return (
        grid.join(covariates, "d")
        .join(prices, ["store_id", "item_id", "wm_yr_wk"], "left")
        .withColumn("sales", F.lit(None).cast("int"))
    )


def pack_forecast(forecast: DataFrame) -> DataFrame:
    """One row per series and origin with its first day and the quantiles of all steps in one array."""
    step = F.struct("d_num", "q10", "q50", "q90")
    packed = forecast.groupBy("origin", "id").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    bands = F.transform("steps", lambda s: F.struct(s["q10"].alias("q10"), s["q50"].alias("q50"), s["q90"].alias("q90")))
    return packed.select("origin", "id", F.col("steps")[0]["d_num"].alias("first_day"), bands.alias("bands"))


def explode_forecast(packed: DataFrame) -> DataFrame:
    """Array forecasts back to one row per day: day = first day + position."""
    return packed.select("origin", "id", "first_day", F.posexplode("bands").alias("pos", "band")).select(
        "origin", "id", (F.col("first_day") + F.col("pos")).alias("d_num"), "band.q10", "band.q50", "band.q90"
    )


def blend_forecasts(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary forecast for every series it covers, the fallback for all others."""
    covered = primary.select("origin", "id").distinct()
    return primary.unionByName(fallback.join(covered, ["origin", "id"], "left_anti"))
