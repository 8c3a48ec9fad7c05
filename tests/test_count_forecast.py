"""The count model: coefficients, dispersion, and paths that feed their own lags."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.operators import count_forecast as c
from tallycast.session import use_checkpoints


@pytest.fixture(scope="module")
def panel(spark):
    """Negative binomial demand with weekdays and a level per series, 340 days known and 28 to come."""
    use_checkpoints(spark)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(24):
        level, y = 1 + i / 3, []
        for d in range(1, 369):
            mean = level * (1.8 if d % 7 == 3 else 0.8) * (1.3 if i % 2 else 1.0)
            y.append(int(rng.poisson(mean * rng.gamma(2.0, 0.5))))
            rows.append((f"S{i:02d}", d, y[-1], d % 7 + 1, int(d % 10 == 1), "CA" if i % 2 else "TX"))
    rows += [("SHORT", d, 1, d % 7 + 1, 0, "WI") for d in range(330, 369)]
    return spark.createDataFrame(rows, "id string, d_num int, sales int, wday int, snap int, state_id string").repartition(6).checkpoint()


@pytest.fixture(scope="module")
def model(panel):
    return c.fit_counts(panel, 340)


def test_fit_finds_the_weekday_and_the_dispersion(model):
    assert model.dispersion == pytest.approx(0.5, abs=0.1)
    assert model.coefficients["wday_4"] == pytest.approx(np.log(1.8 / 0.8), abs=0.1)
    assert set(model.states) == {"TX"} or set(model.states) == {"CA"}


def test_dispersion_against_numpy(spark):
    rng = np.random.default_rng(2)
    mean = rng.gamma(2, 3, 5000)
    sales = rng.poisson(mean * rng.gamma(1 / 0.7, 0.7, 5000)).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(sales, mean)], "sales double, mean double")
    expected = ((sales - mean) ** 2 - mean).sum() / (mean**2).sum()
    assert c.dispersion(df) == pytest.approx(expected) and expected == pytest.approx(0.7, abs=0.1)
    assert c.dispersion(df.withColumn("sales", F.col("mean"))) == 0.0
    assert c.dispersion(df.where("false")) == 0.0


def test_paths_are_equal_under_repartitioning_and_differ_by_seed(panel, model):
    one = {(r.id, r.d_num): r.draws for r in c.sampled_paths(model, panel, 340, 20).collect()}
    two = {(r.id, r.d_num): r.draws for r in c.sampled_paths(model, panel.repartition(11, "d_num"), 340, 20).collect()}
    other = {(r.id, r.d_num): r.draws for r in c.sampled_paths(model, panel, 340, 20, seed=1).collect()}
    assert one == two and one != other and len(one) == 24 * 28


def test_paths_see_no_sales_after_the_origin(panel, model):
    hidden = panel.withColumn("sales", F.when(F.col("d_num") <= 340, F.col("sales")))
    key = lambda r: (r.id, r.d_num)
    assert sorted(c.forecast_counts(model, panel, 340, 20).collect(), key=key) == sorted(c.forecast_counts(model, hidden, 340, 20).collect(), key=key)
    cut = c.fit_counts(panel.where("d_num <= 340"), 340)
    assert cut.coefficients == pytest.approx(model.coefficients) and cut.dispersion == pytest.approx(model.dispersion)


def test_paths_against_a_loop_over_days(panel, model):
    """One series by hand with the same random numbers: every draw enters the lags of the next day."""
    import zlib

    rows = sorted((r for r in panel.where("id = 'S05'").collect()), key=lambda r: r.d_num)
    past = [r.sales for r in rows if r.d_num <= 340]
    random = np.random.default_rng([zlib.crc32(b"S05"), 340, 42])
    gamma = random.gamma(1 / model.dispersion, model.dispersion, (28, 9))
    paths = [list(past) for _ in range(9)]
    b = model.coefficients
    top = 3 * max(past[-28:]) + 10
    expected = []
    for h, row in enumerate(r for r in rows if r.d_num > 340):
        means = []
        for y in paths:
            total = model.intercept + model.states.get(row.state_id, 0.0) + b["log_scale"] * np.log1p(np.mean(past)) + b["snap"] * row.snap
            total += b.get(f"wday_{row.wday}", 0.0) + sum(b[f"log_lag_{n}"] * np.log1p(y[-n]) for n in (1, 7, 28))
            total += sum(b[f"log_mean_{n}"] * np.log1p(np.mean(y[-n:])) for n in (7, 28))
            means.append(min(np.exp(total), top))
        drawn = random.poisson(np.array(means) * gamma[h])
        for y, value in zip(paths, drawn):
            y.append(int(value))
        expected.append(drawn.tolist())
    got = sorted((r for r in c.sampled_paths(model, panel, 340, 9).where("id = 'S05'").collect()), key=lambda r: r.d_num)
    assert [r.draws for r in got] == expected
    first = c.one_step_mean(model, c.count_terms(panel.where("d_num <= 341"), 340)).where("id = 'S05' and d_num = 341").first()
    y, row = past, [r for r in rows if r.d_num == 341][0]
    total = model.intercept + model.states.get(row.state_id, 0.0) + b["log_scale"] * np.log1p(np.mean(past)) + b["snap"] * row.snap + b.get(f"wday_{row.wday}", 0.0)
    total += sum(b[f"log_lag_{n}"] * np.log1p(y[-n]) for n in (1, 7, 28)) + sum(b[f"log_mean_{n}"] * np.log1p(np.mean(y[-n:])) for n in (7, 28))
    assert first["mean"] == pytest.approx(np.exp(total))


def test_bands_cover_the_days_to_come(panel, model):
    """Counts tie, so coverage is bounded from both sides by strict and loose comparison."""
    out = c.forecast_counts(model, panel, 340).join(panel, ["id", "d_num"])
    assert out.where("q10 > q50 or q50 > q90 or q10 < 0").count() == 0
    below, above = out.agg(F.avg((F.col("sales") < F.col("q10")).cast("int")), F.avg((F.col("sales") <= F.col("q90")).cast("int"))).first()
    assert below < 0.1 and 0.87 < above < 0.96


def test_short_series_and_empty_panels(panel, model):
    assert c.sampled_paths(model, panel, 340, 5).where("id = 'SHORT'").count() == 0
    assert c.sampled_paths(model, panel.where("false"), 340, 5).count() == 0
