"""The whole batch from raw CSV tables to report tables.

    python -m tallycast.run --sales sales.csv --calendar calendar.csv --prices prices.csv --out reports

``--out`` must be a folder that every executor can reach. Each step writes a table and the next one
reads it, so a failed run is repaired by running it again.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tallycast.functions.names import HORIZON, publish
from tallycast.operators import coldstart, features, global_forecast, ingest, metrics, policy, reshape
from tallycast.operators.forecasters import seasonal_naive
from tallycast.operators.origins import generate_origins, last_day
from tallycast.operators.sampling import stratified_sample
from tallycast.plans import backtest, reports
from tallycast.sources import tables


def run(
    spark: SparkSession, sales: str, calendar: str, prices: str, out: str, fit_series: int = 2000, trees: int = 200,
) -> dict[str, str]:
    """Run all steps; returns the path of every written table by name.

    Every series is forecast and scored; ``fit_series`` bounds only the series whose windows the global model is fitted on.
    """
    written: dict[str, str] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        """Forecasts and series sets stay Parquet: they grow with the panel."""
        written[name] = f"{out}/{name}"
        df.write.mode("overwrite").parquet(written[name])
        return spark.read.parquet(written[name])

    def report(name: str, df: DataFrame) -> None:
        """Report tables have a row per model, origin, segment or policy."""
        written[name] = tables.write_csv(df, f"{out}/{name}", single_file=True)

    days, weekly = tables.scan_calendar(spark, calendar), tables.scan_prices(spark, prices)
    wide = tables.scan_sales_wide(spark, sales)
    data_days = [int(c[2:]) for c in wide.columns if c.startswith("d_") and c[2:].isdigit()]
    joined = ingest.join_prices(ingest.join_calendar(ingest.melt_sales(wide), days), weekly)
    # The release filter is counted while the panel is written, so the raw files are read once.
    seen = Observation("release")
    watched = joined.observe(seen, F.count(F.lit(1)).alias("rows_before"), F.count("sell_price").alias("rows_after"))
    written["panel"] = f"{out}/panel"
    everything = tables.write_panel_table(
        ingest.assign_split(ingest.drop_pre_release(watched), last_day=max(data_days)), "tallycast_panel", written["panel"],
        tables.bucket_count(wide.count(), len(data_days)),
    )
    counts = spark.createDataFrame([(seen.get["rows_before"], seen.get["rows_after"])], "rows_before long, rows_after long")
    report("pre_release_stats", ingest.release_report(counts))
    report("split_profile", tables.split_profile(everything))

    history = everything.where("split <> 'test'")
    train = everything.where("split = 'train'")
    train_end, val_end, test_end = last_day(train), last_day(history), last_day(everything)
    segments = keep("volume_segment", metrics.volume_segment(train, train_end))

    results = backtest.run_backtest(history, backtest.FORECASTERS, generate_origins(val_end), segments)
    report("backtest_results", results)
    results = tables.read_report(spark, written["backtest_results"])
    report("backtest_summary", backtest.backtest_summary(results))

    fitted = keep("fit_series", stratified_sample(train, fit_series, 43))
    cold = keep("cold_series", coldstart.coldstart_sample(train))
    cutoff = coldstart.coldstart_cutoff_day(train_end)
    ahead = reshape.future_rows(everything, days, weekly, test_end + 1, test_end + HORIZON)
    with_ahead = everything.drop("split").unionByName(ahead, allowMissingColumns=True)
    engineered = keep("features", features.add_lag_features(features.engineer_features(with_ahead)))
    origins = generate_origins(val_end)
    rolling = keep("global_backtest", global_forecast.backtest_global(engineered, origins, fit_ids=fitted, trees=trees))
    rolling_losses = backtest.forecast_losses(history, rolling.withColumn("model", F.lit("global")), origins)
    report("global_backtest_results", backtest.results_by_segment(rolling_losses, segments))

    cold_features = keep("cold_features", features.engineer_features(with_ahead, cold_ids=cold, cutoff_day=cutoff))
    model = global_forecast.fit_global(cold_features, train_end, use_lags=False, fit_ids=fitted, trees=trees)
    forecasts = keep("global_forecast", reduce(
        DataFrame.unionByName,
        [global_forecast.forecast_global(model, cold_features, origin) for origin in (train_end, val_end, test_end)],
    ))
    at = lambda origin: forecasts.where(F.col("origin") == origin)

    visible = coldstart.truncate_coldstart_history(history, cold, cutoff)
    losses = backtest.forecast_losses(visible, at(train_end).withColumn("model", F.lit("global_coldstart")), [train_end])
    scores = backtest.segmented_scores(losses, segments, cold)
    report("coldstart_scores", scores)
    newest = tables.read_report(spark, written["backtest_results"])
    nothing = newest.select("model", "n_series", "wql", "mase").where("false")
    earlier = backtest.model_comparison(nothing, newest, max(origins))
    earlier = backtest.model_comparison(earlier, tables.read_report(spark, written["global_backtest_results"]), max(origins))
    overall = losses.groupBy("model").agg(*metrics.score_columns())
    report("model_comparison", earlier.unionByName(overall))

    trace = policy.inventory_trace(policy.policy_input(everything, at(val_end)))
    summary = policy.policy_summary(policy.policy_per_series(trace))
    report("policy_summary", summary)
    report("policy_headline", policy.policy_headline(summary))

    fallback = seasonal_naive(everything, [val_end, test_end])
    blocks = forecasts.where(F.col("origin").isin(val_end, test_end))
    written["submission"] = tables.write_csv(
        reports.submission_table(blocks, fallback, (val_end, test_end)), f"{out}/submission"
    )
    keep("published_forecast", publish(forecasts))
    keep("series_report", publish(reports.series_report(everything, at(val_end), segments, cold, val_end)))
    return written


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("sales", "calendar", "prices", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--fit-series", type=int, default=2000)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("tallycast").getOrCreate()
    for name, path in run(spark, args.sales, args.calendar, args.prices, args.out, args.fit_series).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
