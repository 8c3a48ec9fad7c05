"""The folded Holt-Winters against a plain loop, and its bands against simulated paths."""

import numpy as np
import pytest

from tallycast.operators.holt_winters_fold import SETTINGS, holt_winters_bands, holt_winters_state


def loop(y, setting):
    alpha, beta, gamma, phi = setting
    level, trend = np.mean(y[:7]), (np.mean(y[7:14]) - np.mean(y[:7])) / 7
    cycle, sse = [v - np.mean(y[:7]) for v in y[:7]], 0.0
    for value in y[7:]:
        error = value - (level + phi * trend + cycle[0])
        level, trend = level + phi * trend + alpha * error, phi * trend + beta * error
        cycle, sse = [*cycle[1:], cycle[0] + gamma * error], sse + error * error
    return sse, level, trend, cycle


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(4)
    return {"A": rng.poisson(5, 90).astype(float), "B": 3 + 0.1 * np.arange(60) + 4 * (np.arange(60) % 7 == 2) + rng.normal(0, 1, 60),
            "ZERO": np.zeros(30), "SHORT": np.ones(13), "EDGE": rng.poisson(2, 14).astype(float)}


@pytest.fixture(scope="module")
def history(spark, series):
    rows = [(k, d + 1, float(v), 1) for k, y in series.items() for d, v in enumerate(y)]
    return spark.createDataFrame(rows, "id string, d_num int, sales double, n int").repartition(5)


def test_states_at_every_origin(history, series):
    origins = [14, 20, 60, 89]
    got = {(r.origin, r.id): r for r in holt_winters_state(history, origins).collect()}
    assert set(got) == {(o, k) for o in origins for k, y in series.items() if min(len(y), o) >= 14}
    for (origin, k), r in got.items():
        y = series[k][:origin]
        best = min(range(len(SETTINGS)), key=lambda i: (loop(y, SETTINGS[i])[0], i))
        sse, level, trend, cycle = loop(y, SETTINGS[best])
        assert (r.n, r.setting) == (len(y), best)
        assert (r.sse, r.level, r.trend, r.cycle) == (pytest.approx(sse), pytest.approx(level), pytest.approx(trend), pytest.approx(cycle))


def test_bands_against_simulated_paths(history, series):
    """With one setting the spread of 40,000 simulated paths is that of the closed form."""
    setting = (0.5, 0.02, 0.2, 0.9)
    got = sorted((r for r in holt_winters_bands(history, [60], 15, settings=(setting,)).where("id = 'B'").collect()), key=lambda r: r.d_num)
    sse, level, trend, cycle = loop(series["B"], setting)
    sigma, n = np.sqrt(sse / 53), 40_000
    rng = np.random.default_rng(0)
    level, trend, cycle = np.full(n, level), np.full(n, trend), [np.full(n, c) for c in cycle]
    for r in got:
        error = rng.normal(0, sigma, n)
        y = level + 0.9 * trend + cycle[0] + error
        low, mid, high = np.maximum(np.quantile(y, (0.1, 0.5, 0.9)), 0)
        assert (r.q10, r.q50, r.q90) == (pytest.approx(low, abs=0.15), pytest.approx(mid, abs=0.15), pytest.approx(high, abs=0.15))
        level, trend, cycle = level + 0.9 * trend + 0.5 * error, 0.9 * trend + 0.02 * error, [*cycle[1:], cycle[0] + 0.2 * error]


def test_constant_and_absent_series(history):
    rows = holt_winters_bands(history, [30], 7).where("id = 'ZERO'").collect()
    assert len(rows) == 7 and all(r.q10 == r.q50 == r.q90 == 0 for r in rows)
    assert holt_winters_bands(history, [13], 7).count() == 0 and holt_winters_bands(history.where("false"), [60], 7).count() == 0
