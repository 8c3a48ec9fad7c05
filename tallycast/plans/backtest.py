"""Rolling-origin backtests and the score reports built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallycast.functions.names import HORIZON, QUANTILES
from tallycast.operators.forecasters import Forecaster, seasonal_naive, trend_weekly
from tallycast.operators.holt_winters import holt_winters
from tallycast.operators.metrics import mase_scale_as_of, score_columns, score_join, series_losses, with_mase

FORECASTERS: dict[str, Forecaster] = {
    "seasonal_naive": seasonal_naive,
    "trend_weekly": trend_weekly,
    "holt_winters": holt_winters,
}


def backtest_losses(
    panel: DataFrame, models: dict[str, Forecaster], origins: list[int], horizon: int = HORIZON
) -> DataFrame:
    """Losses and MASE per model, origin and series. Every model forecasts all origins in one plan."""
    history = panel.select("id", "d_num", "sales").where(F.col("d_num") <= max(origins))
    forecasts = [
        forecaster(history, origins, horizon).withColumn("model", F.lit(name)) for name, forecaster in models.items()
    ]
    forecast = reduce(DataFrame.unionByName, forecasts)
    return forecast_losses(panel, inside_horizon(forecast, origins, horizon), origins, horizon)


def inside_horizon(forecast: DataFrame, origins: list[int], horizon: int = HORIZON) -> DataFrame:
    """The forecast itself; the query fails at a row whose day is not one of the ``horizon`` days after a given origin."""
    step = F.col("d_num") - F.col("origin")
    fine = F.coalesce(F.col("origin").isin(*origins) & step.between(1, horizon), F.lit(False))
    refused = F.raise_error(F.lit("a forecast for a day that is not after its origin and within the horizon"))
    return forecast.withColumn("d_num", F.when(fine, F.col("d_num")).otherwise(refused.cast("long")).cast(forecast.schema["d_num"].dataType))


def require_blind(panel: DataFrame, models: dict[str, Forecaster], origins: list[int], horizon: int = HORIZON) -> None:
    """Raise if a forecaster's rows for the first origin change once later days are taken out of its history."""
    first = min(origins)
    history = panel.select("id", "d_num", "sales").where(F.col("d_num") <= max(origins))
    for name, forecaster in models.items():
        whole = forecaster(history, origins, horizon).where(F.col("origin") == first)
        blind = forecaster(history.where(F.col("d_num") <= first), [first], horizon)
        columns = ["id", "d_num", *[F.round(q, 6).alias(q) for q in QUANTILES]]
        changed = whole.select(*columns).exceptAll(blind.select(*columns))
        if whole.count() != blind.count() or not changed.isEmpty():
            raise ValueError(f"{name} reads days after its origin")


def forecast_losses(panel: DataFrame, forecast: DataFrame, origins: list[int], horizon: int = HORIZON) -> DataFrame:
    """The same losses for forecasts that exist already, labelled with their ``model``."""
    history = panel.select("id", "d_num", "sales").where(F.col("d_num") <= max(origins))
    scored = score_join(panel, forecast, origins, horizon)
    return with_mase(series_losses(scored, "model"), mase_scale_as_of(history, origins))


def results_by_segment(losses: DataFrame, segments: DataFrame) -> DataFrame:
    """Scores per model and origin: overall, and one row per volume segment.

    A series without a segment counts in the overall row only.
    """
    tagged = losses.join(segments.select("id", "volume_segment"), "id", "left")
    keys = [F.col("model"), F.col("origin")]
    scores = tagged.groupingSets([keys, [*keys, F.col("volume_segment")]], *keys, F.col("volume_segment")).agg(
        F.grouping("volume_segment").alias("is_overall"), *score_columns()
    )
    named = scores.withColumn("segment", F.when(F.col("is_overall") == 1, "overall").otherwise(F.col("volume_segment")))
    return named.where("segment is not null").select("model", "origin", "segment", "n_series", "wql", "mase")


def run_backtest(
    panel: DataFrame, models: dict[str, Forecaster], origins: list[int], segments: DataFrame, horizon: int = HORIZON,
    trusted: bool = False,
) -> DataFrame:
    """Scores of forecasters that are checked first to see no day after their origin, unless they are ``trusted``."""
    if not trusted:
        require_blind(panel, models, origins, horizon)
    return results_by_segment(backtest_losses(panel, models, origins, horizon), segments)


def backtest_summary(results: DataFrame) -> DataFrame:
    """Mean and sample deviation of the scores over the origins; also how many scores were undefined."""
    return results.groupBy("model", "segment").agg(
        F.avg("wql").alias("wql_mean"),
        F.stddev_samp("wql").alias("wql_std"),
        F.avg("mase").alias("mase_mean"),
        F.stddev_samp("mase").alias("mase_std"),
        F.avg("n_series").alias("avg_n_series"),
        F.count("origin").alias("n_origins"),
        F.sum(F.when(F.col("wql").isNull() | F.col("mase").isNull(), 1).otherwise(0)).alias("n_undefined"),
    )


def segmented_scores(losses: DataFrame, segments: DataFrame, cold_ids: DataFrame) -> DataFrame:
    """Overall, cold/warm start and high/long volume scores of one forecast, in one grouping-sets pass."""
    tagged = (
        losses.join(segments.select("id", "volume_segment"), "id", "left")
        .join(cold_ids.select("id", F.lit("cold_start").alias("start")), "id", "left")
        .withColumn("start", F.coalesce("start", F.lit("warm_start")))
    )
    keys, start, volume = [F.col("model"), F.col("origin")], F.col("start"), F.col("volume_segment")
    scores = tagged.groupingSets([keys, [*keys, start], [*keys, volume]], *keys, start, volume).agg(
        F.grouping("start").alias("no_start"), F.grouping("volume_segment").alias("no_volume"), *score_columns()
    )
    kind = F.when(F.col("no_start") == 0, "start").when(F.col("no_volume") == 0, "volume").otherwise("overall")
    name = F.when(F.col("no_start") == 0, start).when(F.col("no_volume") == 0, volume).otherwise(F.lit("overall"))
    return (
        scores.withColumn("segment_type", kind)
        .withColumn("segment", name)
        .where("segment is not null")
        .select("model", "origin", "segment_type", "segment", "n_series", "wql", "mase")
    )


def coldstart_comparison(scores: DataFrame) -> DataFrame:
    """Cold next to warm and high next to long, one row per metric."""
    rows = scores.where("segment_type <> 'overall'").select(
        "model", "origin", "segment_type", "segment",
        F.explode(F.array(
            F.struct(F.lit("n_series").alias("metric"), F.col("n_series").cast("double").alias("value")),
            F.struct(F.lit("wql").alias("metric"), F.col("wql").alias("value")),
            F.struct(F.lit("mase").alias("metric"), F.col("mase").alias("value")),
        )).alias("m"),
    ).select("model", "origin", "segment_type", "segment", "m.*")
    names = ["cold_start", "warm_start", "high_volume", "long_tail"]
    return rows.groupBy("model", "origin", "metric").pivot("segment", names).agg(F.first("value"))


def model_comparison(earlier: DataFrame, results: DataFrame, origin: int) -> DataFrame:
    """An earlier comparison table extended by the overall rows of new models at one origin."""
    overall = results.where((F.col("segment") == "overall") & (F.col("origin") == origin))
    return earlier.unionByName(overall.select("model", "n_series", "wql", "mase"))
