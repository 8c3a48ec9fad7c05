"""Per-series forecasters. Each takes a history and a list of origins and returns

``[origin, id, d_num, q10, q50, q90]`` for the ``horizon`` days after every origin, seeing only rows up to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallycast.functions.names import HORIZON, SEASON
from tallycast.functions.quantiles import nearest_of_sorted, repair_quantiles
from tallycast.operators.metrics import seasonal_differences
from tallycast.operators.origins import sums_as_of

Forecaster = Callable[[DataFrame, list[int], int], DataFrame]
FORECAST_COLUMNS = ["origin", "id", "d_num", "q10", "q50", "q90"]
FORECAST_SCHEMA = "origin long, id string, d_num long, q10 double, q50 double, q90 double"

# Fixed value: the standard normal deviate of an 80 % interval.
Z80 = 1.2815515655446004


def horizon_grid(series: DataFrame, horizon: int = HORIZON, lag: int = SEASON) -> DataFrame:
    """Every forecast step of rows that carry an ``origin``, with its position in the seasonal pattern."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    return series.select("*", steps).withColumns(
        {"pattern_idx": (F.col("h") - 1) % lag, "d_num": (F.col("origin") + F.col("h")).cast("long")}
    )


def rows_seen(origins: list[int]) -> list[Column]:
    """Aggregate: for each origin, how many rows of a series it may see."""
    counts = [
        F.struct(F.lit(o).cast("long").alias("origin"), F.count_if(F.col("d_num") <= o).alias("n")) for o in origins
    ]
    return [F.array(*counts).alias("seen")]


def series_arrays(history: DataFrame, origins: list[int], *more: Column) -> DataFrame:
    """One row per series with its days and sales in day order, and ``more`` aggregates.

    (id, d_num) is unique, so an array holds at most one entry per day and stays small for any series.
    """
    seen = history.where(F.col("d_num") <= max(origins))
    point = F.struct(F.col("d_num").cast("long").alias("d_num"), F.col("sales").cast("double").alias("sales"))
    return seen.groupBy("id").agg(F.sort_array(F.collect_list(point)).alias("points"), *more)


def last_pattern(history: DataFrame, lag: int = SEASON) -> DataFrame:
    """The last ``lag`` rows of every series that has that many, numbered from 0 in day order."""
    newest_first = W.partitionBy("id").orderBy(F.col("d_num").desc())
    tail = (
        history.withColumn("place", F.row_number().over(newest_first))
        .where(F.col("place") <= lag)
        .withColumn("n_rows", F.count(F.lit(1)).over(W.partitionBy("id")))
        .where(F.col("n_rows") == lag)
    )
    return tail.select("id", (lag - F.col("place")).alias("pattern_idx"), "sales")


def resid_quantiles(history: DataFrame, lag: int = SEASON) -> DataFrame:
    """Nearest-rank 0.1 and 0.9 quantiles of the seasonal residuals of every series."""
    sorted_resid = F.sort_array(F.collect_list("resid"))
    per_series = seasonal_differences(history, lag).groupBy("id").agg(sorted_resid.alias("r"))
    return per_series.select(
        "id",
        nearest_of_sorted(F.col("r"), 0.1).alias("resid_q10"),
        nearest_of_sorted(F.col("r"), 0.9).alias("resid_q90"),
    )


def seasonal_naive(history: DataFrame, origins: list[int], horizon: int = HORIZON, lag: int = SEASON) -> DataFrame:
    """The last ``lag`` values repeated; the spread comes from the series' own seasonal residuals.

    Residuals are taken once per series. Days are in order, so what an origin may see of sales and
    residuals is a prefix whose length is a plain conditional count.
    """
    y = F.col("points.sales")
    n_resid = F.greatest(F.size(y) - lag, F.lit(0))
    resid = F.zip_with(F.slice(y, lag + 1, n_resid), F.slice(y, 1, n_resid), lambda now, then: now - then)
    # A step of its own: next to the explode, the residuals would be computed again for every origin.
    whole = series_arrays(history, origins, *rows_seen(origins)).select(
        "id", "seen", y.alias("y"), resid.alias("resid")
    )
    n = F.col("seen.n").cast("int")
    visible = whole.select("id", "y", "resid", F.explode("seen").alias("seen")).where(n >= lag).select(
        "id",
        F.col("seen.origin").alias("origin"),
        F.slice("y", n - lag + 1, lag).alias("pattern"),
        F.sort_array(F.slice("resid", 1, n - lag)).alias("resid"),
    )
    per_series = visible.select(
        "id",
        "origin",
        "pattern",
        F.coalesce(nearest_of_sorted(F.col("resid"), 0.1), F.lit(0.0)).alias("low"),
        F.coalesce(nearest_of_sorted(F.col("resid"), 0.9), F.lit(0.0)).alias("high"),
    )
    point = F.element_at("pattern", F.col("pattern_idx") + 1)
    raw = horizon_grid(per_series, horizon, lag).select(
        "origin", "id", "d_num",
        (point + F.col("low")).alias("q10"), point.alias("q50"), (point + F.col("high")).alias("q90"),
    )
    return repair_quantiles(raw).select(*FORECAST_COLUMNS)


def _weekday(day: Column) -> Column:
    return F.pmod(day, F.lit(SEASON))


def trend_weekly(history: DataFrame, origins: list[int], horizon: int = HORIZON, min_days: int = 14) -> DataFrame:
    """Linear trend plus weekday effects with an 80 % band, from sums alone.

    Least squares, weekday means of the detrended values and the deviation of what remains all follow
    from six sums per weekday, so every series and origin is fitted by two small aggregations.
    """
    x, y = F.col("d_num").cast("double"), F.col("sales").cast("double")
    sums = {"n": F.lit(1), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y}
    by_weekday = sums_as_of(
        history.withColumn("weekday_idx", _weekday(F.col("d_num"))), ["id", "weekday_idx"], sums, origins
    )
    names = list(sums)
    fits = (
        by_weekday.groupBy("origin", "id")
        .agg(
            *[F.sum(c).alias(c) for c in names],
            F.map_from_entries(F.collect_list(F.struct("weekday_idx", F.struct(*names)))).alias("week"),
        )
        .where(F.col("n") >= min_days)
        .withColumn("slope", (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"))
                    / (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")))
        .withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    )

    def remaining(total: Column, w: Column) -> Column:
        b = F.col("slope")
        yy = w["syy"] - w["sy"] * w["sy"] / w["n"]
        xy = w["sxy"] - w["sx"] * w["sy"] / w["n"]
        xx = w["sxx"] - w["sx"] * w["sx"] / w["n"]
        return total + yy - 2 * b * xy + b * b * xx

    squares = F.aggregate(F.map_values("week"), F.lit(0.0), remaining)
    spread = fits.withColumn("sigma", F.sqrt(F.greatest(squares, F.lit(0.0)) / (F.col("n") - 1)))
    steps = horizon_grid(spread, horizon).withColumn("w", F.try_element_at("week", _weekday(F.col("d_num")).cast("long")))
    w = F.col("w")
    effect = (w["sy"] - F.col("intercept") * w["n"] - F.col("slope") * w["sx"]) / w["n"]
    centre = F.col("intercept") + F.col("slope") * F.col("d_num") + F.coalesce(effect, F.lit(0.0))
    raw = steps.select(
        "origin", "id", "d_num",
        (centre - Z80 * F.col("sigma")).alias("q10"), centre.alias("q50"), (centre + Z80 * F.col("sigma")).alias("q90"),
    )
    return repair_quantiles(raw).select(*FORECAST_COLUMNS)


def per_series_forecaster(fit: Callable, min_rows: int = 1) -> Forecaster:
    """Turn ``fit(days, sales, origin, horizon) -> (q10, q50, q90) arrays`` or None into a forecaster.

    Series without enough rows, or for which ``fit`` gives None, are absent from the result.
    """

    def forecast(history: DataFrame, origins: list[int], horizon: int = HORIZON) -> DataFrame:
        def run(batches):
            import numpy as np
            import pandas as pd

            for batch in batches:
                parts = []
                for sid, days, sales in zip(batch["id"], batch["days"], batch["sales"]):
                    for origin in origins:
                        seen = np.searchsorted(days, origin, side="right")
                        bands = fit(days[:seen], sales[:seen], origin, horizon) if seen >= min_rows else None
                        if bands is not None:
                            step = np.arange(1, horizon + 1)
                            parts.append(pd.DataFrame(
                                {"origin": origin, "id": sid, "d_num": origin + step,
                                 "q10": bands[0], "q50": bands[1], "q90": bands[2]}
                            ))
                if parts:
                    yield pd.concat(parts)

        arrays = series_arrays(history, origins).select(
            "id", F.col("points.d_num").alias("days"), F.col("points.sales").alias("sales")
        )
        raw = arrays.mapInPandas(run, FORECAST_SCHEMA)
        return repair_quantiles(raw).select(*FORECAST_COLUMNS)

    return forecast
