"""Report tables: per-series history with its forecast, the series picker and the submission table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallycast.functions.names import HORIZON
from tallycast.operators.reshape import blend_forecasts, forecast_wide


def series_report(
    panel: DataFrame, forecast: DataFrame, segments: DataFrame, cold_ids: DataFrame, origin_day: int,
    history_days: int = 120,
) -> DataFrame:
    """Recent history and forecast days of every series; history rows carry NULL quantiles."""
    recent = panel.where(F.col("d_num") > origin_day - history_days).select("id", "cat_id", "d_num", "sales")
    return (
        recent.join(forecast.select("id", "d_num", "q10", "q50", "q90"), ["id", "d_num"], "left")
        .join(segments.select("id", "volume_segment"), "id", "left")
        .join(cold_ids.select("id", F.lit(True).alias("is_coldstart")), "id", "left")
        .withColumn("is_coldstart", F.coalesce("is_coldstart", F.lit(False)))
    )


def series_picker(report: DataFrame, cold_only: bool = False, category: str | None = None) -> DataFrame:
    """The distinct series of a report under the chosen filters, in order."""
    chosen = report.where("is_coldstart") if cold_only else report
    if category is not None:
        chosen = chosen.where(F.col("cat_id") == category)
    return chosen.select("id", "cat_id").distinct().orderBy("id")


def submission_table(primary: DataFrame, fallback: DataFrame, origins: tuple[int, int], horizon: int = HORIZON) -> DataFrame:
    """Two consecutive blocks of median forecasts for every series, anchored on the ends of val and test."""
    return forecast_wide(blend_forecasts(primary, fallback), dict(zip(origins, ("validation", "evaluation"))), horizon)
