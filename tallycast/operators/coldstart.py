"""Simulated new products: cutoff day, history truncation and the holdout sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallycast.functions.names import COLDSTART_VISIBLE_DAYS
from tallycast.operators.sampling import stratified_sample


def coldstart_cutoff_day(origin_day: int, visible_days: int = COLDSTART_VISIBLE_DAYS) -> int:
    """First day kept for a cold series, so that exactly ``visible_days`` days are visible at the origin."""
    return origin_day - visible_days + 1


def truncate_coldstart_history(panel: DataFrame, cold_ids: DataFrame, cutoff_day: int) -> DataFrame:
    """Delete all rows before the cutoff for the series in ``cold_ids`` and keep every other row."""
    marked = panel.join(cold_ids.select("id", F.lit(True).alias("is_cold")), "id", "left")
    return marked.where(F.col("is_cold").isNull() | (F.col("d_num") >= cutoff_day)).drop("is_cold")


def coldstart_sample(ids_cats: DataFrame, frac: float = 0.05, seed: int = 44) -> DataFrame:
    """The cold-start holdout: a stratified sample of ``frac`` of all series."""
    series = ids_cats.select("id", "cat_id").distinct()
    size = series.agg(F.bround(F.lit(frac) * F.count(F.lit(1)))).scalar()
    return stratified_sample(series, size, seed)
