"""From raw tables to the processed panel: melt, calendar and price joins, release filter, time split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallycast.functions.names import CALENDAR_COLUMNS, EVENT_COLUMNS, HORIZON, ID_COLUMNS


def melt_sales(wide: DataFrame) -> DataFrame:
    """Every ``d_<n>`` column becomes a row.

    The day columns are packed into one array and exploded, so that a table with thousands of day
    columns needs one generator per row instead of one projection per column. The array is built from
    one SQL text because thousands of single column objects take the driver longer than the melt.
    """
    days = [c for c in wide.columns if c.startswith("d_")]
    values = F.expr("array(" + ", ".join(f"cast(`{c}` as int)" for c in days) + ")")
    name = F.get(F.split(F.lit(",".join(days)), ","), F.col("pos"))
    return (
        wide.select(*ID_COLUMNS, F.posexplode(values).alias("pos", "sales"))
        .select(*ID_COLUMNS, name.alias("d"), "sales")
        .withColumn("d_num", F.substring("d", 3, 10).cast("int"))
    )


def join_calendar(long: DataFrame, calendar: DataFrame) -> DataFrame:
    """Attach the calendar by day; missing event names and types become ``none``."""
    days = calendar.select(*CALENDAR_COLUMNS).fillna("none", EVENT_COLUMNS)
    return long.join(days, "d", "left")


def join_prices(panel: DataFrame, prices: DataFrame) -> DataFrame:
    """Attach the weekly price; a row without one lies before the release of its item."""
    return panel.join(prices, ["store_id", "item_id", "wm_yr_wk"], "left")


def drop_pre_release(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("sell_price").isNotNull())


def pre_release_stats(panel: DataFrame) -> DataFrame:
    """How many rows the release filter keeps and drops, from one aggregate over the unfiltered panel."""
    return release_report(panel.agg(F.count(F.lit(1)).alias("rows_before"), F.count("sell_price").alias("rows_after")))


def release_report(counts: DataFrame) -> DataFrame:
    """The same table from the two counts ``rows_before`` and ``rows_after``."""
    dropped = F.col("rows_before") - F.col("rows_after")
    return counts.select(
        "rows_before",
        "rows_after",
        dropped.alias("rows_dropped"),
        F.coalesce(F.round(F.try_divide(100.0 * dropped, F.col("rows_before")), 2), F.lit(0.0)).alias("pct_dropped"),
    )


def assign_split(
    panel: DataFrame, test_days: int = HORIZON, val_days: int = HORIZON, last_day: int | None = None
) -> DataFrame:
    """Label the last days ``test``, those before ``val`` and the rest ``train``, from the data's own last day.

    Finding that day runs the plan of ``panel`` once more; pass ``last_day`` where it is known already.
    """
    end = panel.agg(F.max("d_num")).scalar() if last_day is None else F.lit(last_day)
    age = end - F.col("d_num")
    return panel.withColumn(
        "split",
        F.when(age < test_days, "test").when(age < test_days + val_days, "val").otherwise("train"),
    )


def build_panel(
    long: DataFrame, calendar: DataFrame, prices: DataFrame, last_day: int | None = None
) -> DataFrame:
    """The whole ingest as one lazy plan."""
    return assign_split(drop_pre_release(join_prices(join_calendar(long, calendar), prices)), last_day=last_day)

