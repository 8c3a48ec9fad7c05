"""Forecast accuracy: scored rows, weighted quantile loss and MASE per series, segment and origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallycast.functions.losses import loss_parts, wql_of_parts
from tallycast.functions.names import HIGH_VOLUME_LEVEL, SEASON
from tallycast.functions.quantiles import exact_quantile
from tallycast.operators.features import by_day
from tallycast.operators.origins import future_window, sums_as_of
from tallycast.session import use_checkpoints


def score_join(panel: DataFrame, forecast: DataFrame, origins: list[int], horizon: int) -> DataFrame:
    """Actuals next to the forecast of the same origin, series and day; unmatched rows leave."""
    actuals = future_window(panel.select("id", "d_num", "sales"), origins, horizon)
    return actuals.join(forecast, ["origin", "id", "d_num"])


def seasonal_differences(history: DataFrame, lag: int = SEASON) -> DataFrame:
    """Rows with ``resid`` = sales minus the sales ``lag`` rows earlier, where that row exists."""
    return history.withColumn("resid", F.col("sales") - F.lag("sales", lag).over(by_day())).where("resid is not null")


def mase_scale(history: DataFrame, lag: int = SEASON) -> DataFrame:
    """Mean absolute seasonal difference per series."""
    return seasonal_differences(history, lag).groupBy("id").agg(F.avg(F.abs("resid")).alias("scale"))


def mase_scale_as_of(history: DataFrame, origins: list[int], lag: int = SEASON) -> DataFrame:
    """The same scale per origin, each from the history up to that origin."""
    sums = {"total": F.abs("resid"), "n": F.lit(1)}
    return sums_as_of(seasonal_differences(history, lag), ["id"], sums, origins).select(
        "origin", "id", (F.col("total") / F.col("n")).alias("scale")
    )


def series_losses(scored: DataFrame, *extra_keys: str) -> DataFrame:
    """Additive losses per origin and series: the common input of every score below."""
    return scored.groupBy("origin", "id", *extra_keys).agg(*loss_parts())


def with_mase(losses: DataFrame, scale: DataFrame) -> DataFrame:
    """MASE per series: its mean absolute error over its scale, NULL where the scale is zero or missing."""
    ratio = F.when(F.col("scale") > 0, F.col("abs_error") / F.col("n_days") / F.col("scale"))
    return losses.join(scale, ["origin", "id"], "left").withColumn("mase", ratio)


def score_columns():
    """Group scores over per-series losses: demand-weighted WQL, unweighted mean MASE."""
    return [
        F.count(F.lit(1)).alias("n_series"),
        wql_of_parts().alias("wql"),
        F.avg("mase").alias("mase"),
    ]


def volume_segment(panel: DataFrame, last_train_day: int, level: float = HIGH_VOLUME_LEVEL) -> DataFrame:
    """``high_volume`` for the series at or above the given quantile of mean daily sales, else ``long_tail``.

    The threshold needs several looks at the means, so they are checkpointed: the panel is read once.
    """
    use_checkpoints(panel.sparkSession)
    volume = (
        panel.where(F.col("d_num") <= last_train_day)
        .groupBy("id")
        .agg((F.sum("sales") / F.count("sales")).alias("avg_daily_sales"))
        .checkpoint()
    )
    threshold = exact_quantile(volume, "avg_daily_sales", level).scalar()
    return volume.withColumn(
        "volume_segment", F.when(F.col("avg_daily_sales") >= threshold, "high_volume").otherwise("long_tail")
    )
