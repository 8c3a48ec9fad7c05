"""Features of new days from a stored state, pointer windows and stored sketches, each against its whole-history form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.operators import features, training_data
from tallycast.session import scratch_path
from tallycast.sources import tables


@pytest.fixture(scope="module")
def panel(spark):
    """A series with gaps, one that begins later, one that ends early, one with a price change at a border, one very short."""
    rng = np.random.default_rng(7)
    rows = []
    for i, days in {"GAPS": [d for d in range(1, 101) if d % 5], "LATE": range(65, 101), "ENDS": range(1, 50), "PRICE": range(1, 101), "TINY": range(59, 62)}.items():
        for d in days:
            price = 2.0 if i == "PRICE" and d > 60 else 1.0
            rows.append((i, d, int(rng.integers(0, 9)), price, d % 7 + 1, d % 12 + 1, 2000, "CA", 1, 0, 0))
    return spark.createDataFrame(
        rows, "id string, d_num int, sales int, sell_price double, wday int, month int, year int, state_id string, snap_CA int, snap_TX int, snap_WI int").repartition(5)


def key(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("borders", [(60,), (30, 60, 80), (1, 2, 99), (64, 100)])
def test_day_ranges_equal_the_whole_history(spark, panel, borders):
    whole = features.add_lag_features(features.engineer_features(panel))
    state = features.feature_state(panel.where(F.col("d_num") <= borders[0]))
    for low, high in zip(borders, [*borders[1:], 100]):
        path = tables.write_parquet(state, scratch_path(spark, "state"))
        state = spark.read.parquet(path)
        new = panel.where(F.col("d_num").between(low + 1, high))
        fresh, state = features.carry_features(state, new)
        expected = whole.where(F.col("d_num").between(low + 1, high))
        assert key(fresh.select(*expected.columns).collect()) == key(expected.collect())
    assert state.groupBy("id").count().agg(F.max("count")).first()[0] <= 28
    assert key(state.collect()) == key(features.feature_state(panel).select(*state.columns).collect())


def test_the_plan_reads_no_older_day(spark, panel):
    path = scratch_path(spark, "days")
    panel.withColumn("block", F.floor(F.col("d_num") / 50)).write.partitionBy("block").parquet(path)
    state = spark.read.parquet(tables.write_parquet(features.feature_state(panel.where("d_num < 50")), scratch_path(spark, "state")))
    fresh, after = features.carry_features(state, spark.read.parquet(path).where("block = 1").drop("block"))
    for out in (fresh, after):
        files = [f for f in out.inputFiles() if f.startswith(f"file:{path}") or f.startswith(f"file://{path}")]
        scans = out._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(block" in scans and "= 1)]" in scans and files


def test_no_new_days_and_no_state(spark, panel):
    state = features.feature_state(panel)
    fresh, after = features.carry_features(state, panel.where("false"))
    assert fresh.count() == 0 and key(after.select(*state.columns).collect()) == key(state.collect())
    fresh, _ = features.carry_features(state.where("false"), panel)
    whole = features.add_lag_features(features.engineer_features(panel))
    assert key(fresh.select(*whole.columns).collect()) == key(whole.collect())


@pytest.mark.parametrize("lag_rows", [0, 10])
def test_pointer_windows_equal_copied_windows(panel, lag_rows):
    copied = training_data.training_windows(panel, 20, 5, 7, lag_rows=lag_rows)
    index = training_data.window_index(panel, 20, 5, 7, lag_rows=lag_rows)
    read = training_data.window_values(index, training_data.series_store(panel, ["sales", "sell_price"]), ["sales", "sell_price"])
    assert key(read.select("id", "encoder_sales", "decoder_sales").collect()) == key(copied.select("id", "encoder", "decoder").toDF("id", "encoder_sales", "decoder_sales").collect())
    assert read.where("size(encoder_sell_price) <> encoder_len or size(decoder_sell_price) <> decoder_len").count() == 0


def test_strides_and_short_series(panel):
    index = training_data.window_index(panel, 20, 5, 7, stride=4)
    whole = training_data.window_index(panel, 20, 5, 7)
    assert 0 < index.count() <= whole.count() / 3 and whole.where("id = 'TINY'").count() == 0
    assert training_data.window_index(panel.where("false")).count() == 0


def test_sketches_merge_and_estimate(spark):
    df = spark.range(60_000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 700).cast("int").alias("d_num"), F.lit("train").alias("split"))
    whole = tables.series_sketches(df, 10_000)
    parts = tables.series_sketches(df, 50).unionByName(tables.series_sketches(df.where("id % 3 = 0"), 90).withColumn("rows", F.lit(0).cast("long")))
    one, many = tables.profile_of_sketches(whole).first(), tables.profile_of_sketches(parts).first()
    assert one == many and one.rows == 60_000 and (one.min_day, one.max_day) == (0, 699)
    assert abs(one.n_series - 60_000) < 0.03 * 60_000
    few = tables.profile_of_sketches(tables.series_sketches(df.where("id < 100"))).first()
    assert few.n_series == 100
