import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.operators import coldstart, features, training_data
from tallycast.operators.global_forecast import fit_global, forecast_global, load_global, save_global
from tallycast.session import scratch_path


def global_panel(spark, days=150, n=2):
    rng = np.random.default_rng(7)
    rows = [
        (f"S{s}", f"cat{s % 2}", "dept", "store", "CA", d, int(rng.poisson(5 + 3 * (d % 7 == 0) + s)), 1 + d % 7, 1 + d // 30, 2015,
         f"day{d % 7}", "none", "none", "none", "none", d % 2, 0, 0, 2.0 + (d > 60))
        for s in range(n) for d in range(1, days + 1)
    ]
    return spark.createDataFrame(
        rows, "id string, cat_id string, dept_id string, store_id string, state_id string, d_num int, sales int, wday int, "
        "month int, year int, weekday string, event_name_1 string, event_type_1 string, event_name_2 string, "
        "event_type_2 string, snap_CA int, snap_TX int, snap_WI int, sell_price double",
    )


def test_panel_targets_are_the_sales_h_days_later(spark):
    data = global_panel(spark, 120)
    panel = training_data.training_panel(features.engineer_features(data), 110, lookback_days=60)
    truth = data.select("id", F.col("d_num").alias("day"), F.col("sales").alias("y"))
    pairs = panel.join(truth, (panel.id == truth.id) & (panel.d_num + panel.h == truth.day))
    assert pairs.count() == panel.count() > 0
    assert pairs.where("target <> y").count() == 0
    assert panel.agg(F.max(F.col("d_num") + F.col("h"))).first()[0] <= 110


def test_panel_falls_back_to_the_latest_candidate(spark):
    short = features.engineer_features(global_panel(spark, 40).where("d_num >= 20"))
    days = {r.d_num for r in training_data.training_panel(short, 40, horizon=28).select("d_num").collect()}
    assert days == set()  # day 12 has no row here
    whole = features.engineer_features(global_panel(spark, 40))
    assert {r.d_num for r in training_data.training_panel(whole, 40, lookback_days=5).select("d_num").collect()} == {12}


def leak_panel(spark):
    rows = [(sid, "c", d, 1 + d % 5) for sid in ("COLD", "WARM") for d in range(1, 401)]
    data = spark.createDataFrame(rows, "id string, cat_id string, d_num int, sales int")
    return coldstart.truncate_coldstart_history(data, spark.createDataFrame([("COLD",)], "id string"), 346)


def test_no_window_of_a_cold_series_starts_before_its_cutoff(spark):
    windows = training_data.training_windows(leak_panel(spark), 60, 1)
    first = {r.id: r.first for r in windows.groupBy("id").agg(F.min("encoder_start").alias("first")).collect()}
    assert first["COLD"] >= 346 and first["WARM"] < 346


@pytest.mark.parametrize("min_encoder, lag_rows", [(30, 0), (1, 28)])
def test_series_that_lose_all_windows_are_reported(spark, min_encoder, lag_rows):
    visible = leak_panel(spark).where("d_num <= 372")
    windows = training_data.training_windows(visible, 60, min_encoder, lag_rows=lag_rows)
    dropped = training_data.dropped_series(visible, windows).collect()
    assert [(r.id, r.n_rows) for r in dropped] == [("COLD", 27)]


def test_predict_windows_are_the_last_ones(spark):
    rows = training_data.training_windows(leak_panel(spark), 60, 1, predict=True).collect()
    assert sorted((r.id, r.decoder_start, len(r.encoder)) for r in rows) == [("COLD", 373, 27), ("WARM", 373, 60)]


def test_unseen_category_gets_its_own_code(spark):
    train = spark.createDataFrame([("b",), ("a",), ("a",)], "c string")
    test = spark.createDataFrame([("a",), ("b",), ("new",)], "c string")
    coded = training_data.encode_categoricals(test, training_data.fit_codes(train, ["c"]))
    assert {r.c: r.c_code for r in coded.collect()} == {"a": 0, "b": 1, "new": 2}


def test_audit_counts_violations(spark):
    df = spark.range(10)
    rows = training_data.leakage_audit({"none": (df, F.col("id") < 0), "three": (df, F.col("id") < 3)}).collect()
    assert [tuple(r) for r in rows] == [("none", 10, 0), ("three", 10, 3)]


@pytest.fixture(scope="module")
def fitted(spark):
    data = global_panel(spark)
    engineered = features.engineer_features(data)
    return data, engineered, fit_global(engineered, 122, trees=5, depth=3)


def test_global_forecast_shape(spark, fitted):
    _, engineered, model = fitted
    rows = forecast_global(model, engineered, 122).collect()
    assert len(rows) == 2 * 28 and {r.d_num for r in rows} == set(range(123, 151))
    assert all(0 <= r.q10 <= r.q50 <= r.q90 for r in rows)


def test_global_forecast_ignores_sales_after_the_origin(spark, fitted):
    data, engineered, model = fitted
    hidden = features.engineer_features(data.withColumn("sales", F.when(F.col("d_num") <= 122, F.col("sales")).otherwise(9999)))
    key = lambda r: (r.id, r.d_num)
    one = sorted(forecast_global(model, engineered, 122).collect(), key=key)
    two = sorted(forecast_global(model, hidden, 122).collect(), key=key)
    assert one == two


def test_later_origin_with_a_reloaded_model_and_future_rows(spark, fitted):
    data, _, model = fitted
    path = scratch_path(spark, "model")
    save_global(model, path)
    future = global_panel(spark, 178).where("d_num > 150").withColumn("sales", F.lit(None).cast("int")).withColumn(
        "event_name_1", F.lit("never seen before")
    )
    engineered = features.engineer_features(data, future_rows=future)
    rows = forecast_global(load_global(spark, path), engineered, 150).collect()
    assert {r.d_num for r in rows} == set(range(151, 179)) and len(rows) == 56


def test_cold_series_get_a_forecast_without_lags(spark):
    cold = spark.createDataFrame([("S1",)], "id string")
    engineered = features.engineer_features(
        global_panel(spark), cold_ids=cold, cutoff_day=coldstart.coldstart_cutoff_day(122)
    )
    model = fit_global(engineered, 122, use_lags=False, trees=3, depth=2)
    assert forecast_global(model, engineered, 122).where("id = 'S1'").count() == 28


def test_held_out_targets_lie_after_all_training_targets(spark):
    from tallycast.operators.global_forecast import held_out_windows

    days = spark.range(1, 200).select(F.col("id").cast("int").alias("d_num")).withColumn("held", held_out_windows(180)).where("d_num <= 152")
    first_held = days.where("held").agg(F.min("d_num")).first()[0] + 1
    last_trained = days.where("not held").agg(F.max("d_num")).first()[0] + 28
    assert last_trained < first_held


def test_prices_know_no_sales_of_their_own_week_or_later(spark):
    from tallycast.sources import demand

    rows = [("a", "x", day, 2, 100 * day) for day in (1, 3, 9, 17, 24)]
    schema = "item_id string, store_id string, d_num int, sales long, cents long"
    price = lambda rows: {(r.wm_yr_wk): r.sell_price for r in demand.sell_prices(spark.createDataFrame(rows, schema), 14).collect()}
    before = price(rows)
    altered = price([r if r[2] < 15 else (*r[:4], 7) for r in rows])
    assert min(before) == 2 and {w: p for w, p in before.items() if w <= 3} == {w: p for w, p in altered.items() if w <= 3}
    assert before[4] != altered[4]


def test_every_series_is_forecast_though_few_are_fitted(spark):
    engineered = features.engineer_features(global_panel(spark))
    few = spark.createDataFrame([("S1",)], "id string")
    model = fit_global(engineered, 122, trees=3, depth=2, fit_ids=few)
    assert forecast_global(model, engineered, 122).select("id").distinct().count() == 2


def test_few_trees_reach_the_error_of_two_hundred(spark, fitted):
    """Skewed demand in the hundreds: scaled targets let a tree move the median far enough."""
    from tallycast.operators.global_forecast import assemble, fit_trees

    data, _, _ = fitted
    skewed = data.withColumn("sales", F.floor(-100 * F.log(1 - (F.pmod(F.xxhash64("id", "d_num"), F.lit(1000)) + 0.5) / 1001)).cast("double"))
    windows, stages = assemble(features.engineer_features(skewed), [122])
    held = windows.where("held_out")
    error = lambda model: model.transform(held).agg(F.avg(F.abs(F.col("target") - F.col("point")))).first()[0]
    few, many = fit_trees(windows, stages, depth=2)[0], fit_trees(windows, stages, trees=200, depth=2, learning_rate=0.05)[0]
    assert few.getNumTrees > 1 and error(few) <= 1.02 * error(many)


def test_leaf_quantiles_against_the_training_targets(spark, fitted):
    """The quantile of all trees' leaf targets, each leaf with the weight of a tree, by plain lists."""
    import numpy as np

    from tallycast.operators import global_forecast as g

    _, engineered, model = fitted
    windows, _ = g.assemble(engineered, [122])
    forest = model.pipeline.stages[-1]
    targets = {}
    for row in forest.transform(windows).collect():
        for tree, leaf in enumerate(row.leaf_ids):
            targets.setdefault((tree, int(leaf)), []).append(row.target)
    stored = {(r.tree, r.leaf): r for r in model.leaves.collect()}
    assert {k: len(v) for k, v in targets.items()} == {k: r.n for k, r in stored.items()}
    points = {k: np.sort(v)[[max(int(np.ceil((i + 0.5) / g.LEAF_POINTS * len(v))) - 1, 0) for i in range(g.LEAF_POINTS)]] for k, v in targets.items()}
    assert all(np.allclose(points[k], r.points) for k, r in stored.items())
    levels = {"low": 0.05, "mid": 0.5, "high": 0.95}
    rows = g.predict_rows(engineered, 122)
    for row in g.leaf_quantiles(model, rows, levels).collect():
        pool = np.sort(np.concatenate([points[tree, int(leaf)] for tree, leaf in enumerate(row.leaf_ids)]))
        scale = np.sqrt(max(row.rolling_mean_28, 0) + 1)
        for name, level in levels.items():
            assert row[name] == pytest.approx(pool[int(np.floor((len(pool) - 1) * level + 0.5))] * scale)


def test_bands_cover_held_out_days_and_differ_inside_a_segment(spark):
    """Two groups of one volume segment, one steady and one restless; continuous demand, so that coverage has no ties."""
    from tallycast.operators.global_forecast import backtest_global

    noise = lambda salt: (F.pmod(F.xxhash64("id", "d_num", F.lit(salt)), F.lit(10_000)) + 0.5) / 10_001
    ids = spark.range(60).select(F.format_string("S%02d", "id").alias("id"), (F.col("id") % 2).alias("restless"))
    days = spark.range(1, 461).select(F.col("id").cast("int").alias("d_num"))
    spread = F.when(F.col("restless") == 1, 8.0).otherwise(1.0)
    panel = ids.crossJoin(days).withColumn("sales", 20 + spread * (noise(1) + noise(2) + noise(3) - 1.5))
    for name in ("item_id", "dept_id", "cat_id", "store_id", "state_id", "weekday", "event_name_1", "event_type_1", "event_name_2", "event_type_2"):
        panel = panel.withColumn(name, F.lit("x"))
    for name in ("snap_CA", "snap_TX", "snap_WI", "wday", "month", "year"):
        panel = panel.withColumn(name, F.lit(1))
    engineered = features.engineer_features(panel.withColumn("sell_price", F.lit(1.0))).checkpoint()
    out = backtest_global(engineered, [376, 404, 432], trees=10, depth=3).join(panel.select("id", "d_num", "sales", "restless"), ["id", "d_num"])
    covered, n = out.agg(F.avg(F.col("sales").between(F.col("q10"), F.col("q90")).cast("int")), F.count("*")).first()
    assert n == 3 * 60 * 28 and abs(covered - 0.8) < 0.03
    width = {r.restless: r.w for r in out.groupBy("restless").agg(F.avg(F.col("q90") - F.col("q10")).alias("w")).collect()}
    assert width[1] > 3 * width[0]


def test_origins_fitted_together_equal_origins_fitted_alone(spark, fitted):
    from tallycast.operators.global_forecast import backtest_global

    _, engineered, _ = fitted
    together = backtest_global(engineered, [110, 122], trees=3, depth=2).where("origin = 110")
    alone = backtest_global(engineered, [110], trees=3, depth=2)
    assert sorted(together.collect()) == sorted(alone.collect()) and alone.count() == 56


def test_windows_of_all_origins_equal_those_of_each(spark):
    engineered = features.engineer_features(global_panel(spark).where("not (id = 'S1' and d_num between 40 and 45)"))
    columns = ["id", "d_num", "h", "target", "target_day"]
    for origins in ([30, 90, 122], [20], [150]):
        tagged = training_data.origin_panels(engineered, origins, lookback_days=60).select("origin", *columns).collect()
        apart = [(o, *r) for o in origins for r in training_data.training_panel(engineered, o, lookback_days=60).select(*columns).collect()]
        assert sorted(map(tuple, tagged)) == sorted(apart)


def test_a_fit_that_fails_reports_its_error(spark, fitted):
    from tallycast.operators.global_forecast import fit_origins

    _, engineered, _ = fitted
    with pytest.raises(Exception):
        fit_origins(engineered, [110, 122], trees=0)


def test_a_saved_model_keeps_its_choices(spark):
    engineered = features.engineer_features(global_panel(spark))
    model = fit_global(engineered, 122, horizon=14, use_lags=False, use_ahead=True, trees=3, depth=2)
    path = scratch_path(spark, "model")
    save_global(model, path)
    again = load_global(spark, path)
    assert (again.use_lags, again.horizon, again.use_ahead) == (False, 14, True)
    assert sorted(forecast_global(again, engineered, 122).collect()) == sorted(forecast_global(model, engineered, 122).collect())
