"""Leakage-safe features. All windows are per series in day order and count rows, not calendar days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tallycast.functions.names import HORIZON, ROLLING_WINDOWS, SNAP_COLUMNS, TARGET_LAGS
from tallycast.operators.coldstart import truncate_coldstart_history


def by_day() -> W:
    """The one window of every feature: Spark then plans one exchange and one sort for all of them."""
    return W.partitionBy("id").orderBy("d_num")


def add_rolling_features(panel: DataFrame, windows=ROLLING_WINDOWS) -> DataFrame:
    """Mean and sample deviation of the rows before the current one; the current day never enters."""
    cols = {}
    for w in windows:
        before = by_day().rowsBetween(-w, -1)
        cols[f"rolling_mean_{w}"] = F.avg("sales").over(before)
        cols[f"rolling_std_{w}"] = F.coalesce(F.stddev_samp("sales").over(before), F.lit(0.0))
    return panel.withColumns(cols)


def add_lag_features(panel: DataFrame, lags=TARGET_LAGS) -> DataFrame:
    return panel.withColumns({f"lag_{n}": F.lag("sales", n).over(by_day()) for n in lags})


def add_price_change_flag(panel: DataFrame) -> DataFrame:
    """1 on the first row of a new price, 0 elsewhere and on the first row of a series."""
    changed = F.col("sell_price") != F.lag("sell_price").over(by_day())
    return panel.withColumn("price_change_flag", F.coalesce(changed, F.lit(False)).cast("byte"))


def add_snap_flag(panel: DataFrame) -> DataFrame:
    """The support-payment flag of the row's own state, 0 for a state without one."""
    flag = F.lit(0)
    for column in SNAP_COLUMNS:
        flag = F.when(F.col("state_id") == column.removeprefix("snap_"), F.col(column)).otherwise(flag)
    return panel.withColumn("snap", flag)


def add_coldstart_flag(panel: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """1 while a series has fewer than ``horizon`` days since its first visible day."""
    first_day = F.min("d_num").over(W.partitionBy("id"))
    return panel.withColumn("coldstart_flag", (F.col("d_num") - first_day + 1 < horizon).cast("long"))


def restrict_series(panel: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the given series. The id set stays a DataFrame, so it may be as large as the panel."""
    return panel.join(ids.select("id"), "id", "left_semi")


def engineer_features(
    panel: DataFrame,
    ids: DataFrame | None = None,
    min_day: int | None = None,
    cold_ids: DataFrame | None = None,
    cutoff_day: int | None = None,
    future_rows: DataFrame | None = None,
) -> DataFrame:
    """The feature chain in its fixed order.

    Future rows and the cold-start truncation come first, so that no feature sees deleted history and a
    price change across the boundary is noticed. The ``min_day`` filter comes last, so that its first
    rows keep their context.
    """
    if ids is not None:
        panel = restrict_series(panel, ids)
    if future_rows is not None:
        panel = panel.unionByName(future_rows, allowMissingColumns=True)
    if cold_ids is not None:
        panel = truncate_coldstart_history(panel, cold_ids, cutoff_day)
    chain = panel.transform(add_coldstart_flag).transform(add_snap_flag)
    chain = chain.transform(add_price_change_flag).transform(add_rolling_features)
    if min_day is not None:
        chain = chain.where(F.col("d_num") >= min_day)
    return typed_features(chain)


def typed_features(chain: DataFrame) -> DataFrame:
    """Whole numbers as longs, price and sales as doubles."""
    longs = ("d_num", "wday", "month", "year", "snap", "price_change_flag", "coldstart_flag")
    doubles = ("sell_price", "sales")
    return chain.withColumns(
        {c: F.col(c).cast("long") for c in longs} | {c: F.col(c).cast("double") for c in doubles}
    )


# --- features of new days alone ------------------------------------------------------------------------

CARRIED_ROWS = max(*ROLLING_WINDOWS, *TARGET_LAGS)


def feature_state(panel: DataFrame) -> DataFrame:
    """What later days need of a panel: the last 28 rows of every series and its ``first_day``. Its size follows the series, not the days."""
    newest_first = W.partitionBy("id").orderBy(F.col("d_num").desc())
    first_day = F.min(F.coalesce("first_day", "d_num") if "first_day" in panel.columns else F.col("d_num")).over(W.partitionBy("id"))
    ranked = panel.withColumn("first_day", first_day).withColumn("__back", F.row_number().over(newest_first))
    return ranked.where(F.col("__back") <= CARRIED_ROWS).drop("__back")


def carry_features(state: DataFrame, new_days: DataFrame, horizon: int = HORIZON) -> tuple[DataFrame, DataFrame]:
    """Features and lags of ``new_days``, and the state after them, from the state before them alone.

    The rows are those of :func:`engineer_features` and :func:`add_lag_features` over the whole history, of which nothing is read. New days must lie after
    the days of the state. Series without a state begin with their first new day; a series without a new day keeps its state. Both results
    read ``state`` and ``new_days``, so these should be tables.
    """
    both = state.withColumn("__new", F.lit(False)).unionByName(new_days.withColumn("__new", F.lit(True)), allowMissingColumns=True)
    first_day = F.min(F.coalesce("first_day", "d_num")).over(W.partitionBy("id"))
    chain = both.withColumn("first_day", first_day).withColumn("coldstart_flag", (F.col("d_num") - F.col("first_day") + 1 < horizon).cast("long"))
    chain = chain.transform(add_snap_flag).transform(add_price_change_flag).transform(add_rolling_features)
    chain = typed_features(chain).transform(add_lag_features)
    return chain.where("__new").drop("__new", "first_day"), feature_state(both.drop("__new"))
