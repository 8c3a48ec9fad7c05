"""The whole batch from CSV tables derived from the smallest order tables."""

from pyspark.sql import functions as F

from tallycast import run
from tallycast.catalog.workspace import Workspace
from tallycast.session import scratch_path
from tallycast.sources import demand, tables


def test_raw_tables_to_reports(spark, sf_dir):
    ws = Workspace(spark, sf_dir)
    root = scratch_path(spark, "run")
    wide = demand.sales_wide(ws.long("coarse"), ws.days()["test"])
    written = run.run(
        spark,
        tables.write_csv(wide, f"{root}/raw/sales"),
        tables.write_csv(ws.calendar(), f"{root}/raw/calendar"),
        tables.write_csv(ws.prices("coarse"), f"{root}/raw/prices"),
        f"{root}/out",
    )
    read = lambda name: spark.read.csv(written[name], header=True, inferSchema=True)
    assert {r.split: r.n_series for r in read("split_profile").collect()} == {"train": 30, "val": 30, "test": 30}
    assert read("backtest_results").count() == 45
    assert {r.model for r in read("model_comparison").collect()} == {
        "seasonal_naive", "trend_weekly", "holt_winters", "global", "global_coldstart"
    }
    submission = read("submission")
    assert submission.count() == 60 and len(submission.columns) == 29
    assert submission.where(" or ".join(f"F{i} is null" for i in range(1, 29))).count() == 0
    assert read("policy_summary").count() == 2
    report = spark.read.parquet(written["series_report"])
    assert "q0.5" in report.columns and report.where(F.col("`q0.5`").isNotNull()).count() == 30 * 28
    forecast = spark.read.parquet(written["global_forecast"])
    assert forecast.where("not (0 <= q10 and q10 <= q50 and q50 <= q90)").count() == 0
