import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.functions.losses import loss_parts, pinball, wql_of_parts
from tallycast.functions.names import publish, unpublish
from tallycast.functions.quantiles import exact_quantile
from tallycast.operators import forecasters, metrics, origins as o
from tallycast.operators.holt_winters import holt_winters
from tallycast.plans import backtest

HISTORY = "id string, d_num int, sales double"


def panel(spark, **series):
    return spark.createDataFrame([(s, d + 1, float(y)) for s, ys in series.items() for d, y in enumerate(ys)], HISTORY)


def bands(df, sid="A"):
    return [(r.q10, r.q50, r.q90) for r in df.where(F.col("id") == sid).orderBy("d_num").collect()]


def test_naive_on_a_periodic_series_has_no_spread(spark):
    out = forecasters.seasonal_naive(panel(spark, A=[1 + d % 7 for d in range(35)]), [35], 7)
    assert bands(out) == [(float(v),) * 3 for v in range(1, 8)]
    assert [r.d_num for r in out.orderBy("d_num").collect()] == list(range(36, 43))


def test_short_series_are_skipped(spark):
    short = panel(spark, A=[1, 2, 3])
    assert forecasters.seasonal_naive(short, [3], 7).count() == 0
    assert forecasters.trend_weekly(short, [3], 7).count() == 0
    assert holt_winters(short, [3], 7).count() == 0


@pytest.mark.parametrize("model", backtest.FORECASTERS.values())
def test_quantiles_are_monotone_and_not_negative(spark, model):
    noise = np.random.default_rng(0).poisson(4, 70)
    rows = bands(model(panel(spark, A=noise), [70], 14))
    assert len(rows) == 14 and all(0 <= a <= b <= c for a, b, c in rows)


@pytest.mark.parametrize("model", [forecasters.trend_weekly, holt_winters])
def test_smooth_series_is_followed(spark, model):
    rows = bands(model(panel(spark, A=[10 + d % 7 for d in range(56)]), [56], 7))
    assert all(abs(q50 - (10 + i % 7)) < 0.6 for i, (_, q50, _) in enumerate(rows))


@pytest.mark.parametrize("model", backtest.FORECASTERS.values())
def test_all_origins_at_once_equal_one_origin_at_a_time(spark, model):
    rng = np.random.default_rng(1)
    data = panel(spark, A=rng.poisson(3, 90), B=rng.poisson(30, 60))
    together = model(data, [40, 60, 90], 5).collect()
    single = [r for origin in (40, 60, 90) for r in model(data.repartition(5), [origin], 5).collect()]
    key = lambda r: (r.origin, r.id, r.d_num)
    assert [tuple(r)[:3] for r in sorted(together, key=key)] == [tuple(r)[:3] for r in sorted(single, key=key)]
    for a, b in zip(sorted(together, key=key), sorted(single, key=key)):
        assert tuple(a)[3:] == pytest.approx(tuple(b)[3:], abs=1e-9)


def test_trend_weekly_against_least_squares(spark):
    rng = np.random.default_rng(2)
    y = rng.poisson(20, 80).astype(float)
    x = np.arange(1, 81)
    slope, intercept = np.polyfit(x, y, 1)
    rest = y - slope * x - intercept
    effect = {w: rest[x % 7 == w].mean() for w in range(7)}
    sigma = np.std(rest - np.array([effect[v % 7] for v in x]), ddof=1)
    for h, (q10, q50, q90) in enumerate(bands(forecasters.trend_weekly(panel(spark, A=y), [80], 10)), start=81):
        centre = intercept + slope * h + effect[h % 7]
        assert q50 == pytest.approx(centre) and q90 - q10 == pytest.approx(2 * 1.2815515655446004 * sigma)


def test_pluggable_per_series_forecaster(spark):
    def mean_forecast(days, sales, origin, horizon):
        return [np.full(horizon, sales.mean() + shift) for shift in (-1, 0, 1)]

    model = forecasters.per_series_forecaster(mean_forecast, min_rows=3)
    out = model(panel(spark, A=[2, 2, 2, 8], B=[1, 1]), [3], 2)
    assert bands(out) == [(1.0, 2.0, 3.0)] * 2 and bands(out, "B") == []


def score(spark, rows):
    df = spark.createDataFrame(rows, "sales double, q10 double, q50 double, q90 double")
    return df.agg(*loss_parts()).agg(wql_of_parts().alias("w")).first().w


def test_wql(spark):
    actual = [5.0, 10.0, 0.0, 3.0]
    assert score(spark, [(y, y, y, y) for y in actual]) == 0
    assert score(spark, [(y, y - 1, y - 1, y - 1) for y in actual]) == pytest.approx(2 * 4 * 0.5 / 18)
    assert score(spark, [(0.0, 1.0, 1.0, 1.0)] * 3) is None


def test_pinball_is_asymmetric(spark):
    loss = lambda y, p, q: spark.range(1).select(pinball(F.lit(y), F.lit(p), q).alias("v")).first().v
    assert loss(10.0, 10.0, 0.9) == 0
    assert loss(10.0, 8.0, 0.9) == pytest.approx(1.8) and loss(8.0, 10.0, 0.9) == pytest.approx(0.2)


def mase_of(spark, history, actual, forecast):
    past = panel(spark, A=history)
    origin = len(history)
    future = spark.createDataFrame([("A", origin + i + 1, float(y)) for i, y in enumerate(actual)], HISTORY)
    bands_df = spark.createDataFrame(
        [(origin, "A", origin + i + 1, *[float(p)] * 3) for i, p in enumerate(forecast)], forecasters.FORECAST_SCHEMA
    )
    scored = metrics.score_join(past.union(future), bands_df, [origin], len(actual))
    return metrics.with_mase(metrics.series_losses(scored), metrics.mase_scale_as_of(past, [origin])).first().mase


def test_mase(spark):
    rising = [w + d for w in range(4) for d in range(7)]
    assert mase_of(spark, rising, [5, 6], [5, 6]) == 0
    assert mase_of(spark, rising, [5, 6], [6, 7]) == pytest.approx(1.0)
    assert mase_of(spark, [3] * 28, [5], [4]) is None
    assert mase_of(spark, [1, 2, 3, 4, 5, 6, 7], [5], [4]) is None


def test_origins():
    assert o.generate_origins(1913) == [1773, 1801, 1829, 1857, 1885]
    with pytest.raises(ValueError, match="earliest origin"):
        o.generate_origins(100)


def test_lazy_origins_agree(spark):
    days = lambda n: spark.range(n, n + 1).withColumnRenamed("id", "d_num")
    assert [r.origin for r in o.origins_table(days(1913)).collect()] == o.generate_origins(1913)
    with pytest.raises(Exception, match="not enough history"):
        o.origins_table(days(100)).collect()


def segments(spark):
    return spark.createDataFrame([("A", "hi"), ("B", "lo")], "id string, volume_segment string")


def test_perfect_forecast_scores_zero_in_every_segment(spark):
    data = panel(spark, A=[10 + d % 7 for d in range(60)], B=[1 + d % 7 for d in range(60)])
    results = backtest.run_backtest(
        data, {"seasonal_naive": forecasters.seasonal_naive}, o.generate_origins(60, 7, 3, 7), segments(spark), 7
    ).collect()
    assert len(results) == 9 and {r.segment for r in results} == {"overall", "hi", "lo"}
    assert all(r.wql == 0 for r in results)
    assert {r.n_series for r in results if r.segment == "overall"} == {2}


def test_series_without_segment_counts_overall_only(spark):
    data = panel(spark, A=range(40), B=range(40), C=range(40))
    results = {r.segment: r.n_series for r in backtest.run_backtest(
        data, {"seasonal_naive": forecasters.seasonal_naive}, [33], segments(spark), 7
    ).collect()}
    assert results == {"overall": 3, "hi": 1, "lo": 1}


def test_summary_over_origins(spark):
    rows = [("m", i, "overall", 2, w, 1.0) for i, w in enumerate((0.1, 0.3, 0.2))]
    df = spark.createDataFrame(rows, "model string, origin int, segment string, n_series long, wql double, mase double")
    out = backtest.backtest_summary(df).first()
    assert out.wql_mean == pytest.approx(0.2) and out.wql_std == pytest.approx(0.1) and out.n_origins == 3


def test_exact_quantile_with_heavy_ties(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.zeros(4000), np.round(rng.gamma(2, 3, 6000), 2)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for level in (0.1, 0.5, 0.8, 0.97):
        rank = math.floor((len(values) - 1) * level + 0.5)
        for accuracy in (20, 100_000):
            assert exact_quantile(df, "v", level, accuracy).first().threshold == np.sort(values)[rank]


def test_published_names_round_trip(spark):
    out = forecasters.seasonal_naive(panel(spark, A=range(20)), [20], 3)
    written = publish(out)
    assert written.columns == ["origin", "id", "d_num", "q0.1", "q0.5", "q0.9"]
    assert sorted(unpublish(written).select(*out.columns).collect()) == sorted(out.collect())


def test_backtest_over_a_bucketed_panel_shuffles_no_history(spark):
    """Without broadcast joins, forecasting and scoring a bucketed panel still exchange only small results."""
    from tallycast.session import scratch_path
    from tallycast.sources.tables import write_panel_table

    data = panel(spark, A=range(60), B=range(60)).withColumn("split", F.lit("train"))
    table = write_panel_table(data, "bucketed_panel_test", scratch_path(spark, "bucketed"), 3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        losses = backtest.backtest_losses(table, {"seasonal_naive": forecasters.seasonal_naive}, [40, 50], 7)
        plan = losses._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert losses.count() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("level", [0.1, 0.5, 0.8, 0.9])
def test_exact_quantile_at_every_small_size(spark, level):
    """Sizes 1 to 60, those with a remainder of 4 by five among them, against the plain rank."""
    rng = np.random.default_rng(9)
    for n in [*range(1, 16), 19, 24, 29, 34, 44, 54, 59, 60]:
        values = rng.permutation(n).astype(float)
        df = spark.createDataFrame([(float(v),) for v in values], "v double").coalesce(1)
        assert exact_quantile(df, "v", level).first().threshold == math.floor((n - 1) * level + 0.5)


def test_exact_quantile_of_nothing(spark):
    assert exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.8).first().threshold is None


def test_a_forecaster_that_looks_ahead_is_refused(spark):
    data = panel(spark, A=list(range(40)), B=list(range(40, 0, -1)))

    def peeking(history, origins, horizon=28):
        latest = history.groupBy("id").agg(F.max("sales").cast("double").alias("q50"))
        return forecasters.horizon_grid(latest.withColumn("origin", F.explode(F.array(*map(F.lit, origins)))), horizon).select(
            F.col("origin").cast("long").alias("origin"), "id", F.col("d_num").cast("long").alias("d_num"),
            F.col("q50").alias("q10"), "q50", F.col("q50").alias("q90"))

    segs = spark.createDataFrame([("A", "long_tail"), ("B", "long_tail")], "id string, volume_segment string")
    with pytest.raises(ValueError, match="reads days after its origin"):
        backtest.run_backtest(data, {"peeking": peeking}, [20, 30], segs, 5)


def test_a_forecast_for_a_day_up_to_its_origin_is_refused(spark):
    early = spark.createDataFrame([(20, "A", 20, 1.0, 1.0, 1.0)], "origin long, id string, d_num long, q10 double, q50 double, q90 double")
    with pytest.raises(Exception, match="not after its origin"):
        backtest.inside_horizon(early, [20], 5).collect()


def test_wide_blocks_with_and_without_suffix(spark):
    from tallycast.operators.reshape import forecast_wide

    rows = [(o, name, o + 1, 0.0, float(o), 9.0) for o in (10, 20) for name in ("A", "B_evaluation", "C_validation")]
    wide = forecast_wide(
        spark.createDataFrame(rows, "origin long, id string, d_num long, q10 double, q50 double, q90 double"), {10: "validation", 20: "evaluation"}, 1)
    assert sorted(map(tuple, wide.collect())) == sorted(
        (f"{name}_{block}", value) for name in "ABC" for block, value in (("validation", 10.0), ("evaluation", 20.0)))
