import numpy as np
import pytest

from tallycast.operators import policy

SCHEMA = "id string, d_num int, sales int, sell_price double, q10 double, q50 double, q90 double"


def merged(spark, days, sales, q50, q90, price=8.0, sid="A"):
    return spark.createDataFrame([(sid, d, sales, price, 0.0, q50, q90) for d in range(days)], SCHEMA)


def outcome(df, name):
    return policy.policy_per_series(policy.inventory_trace(df)).where(f"policy = '{name}'").first()


def test_stockouts_when_the_median_is_too_low(spark):
    row = outcome(merged(spark, 7, 10, 2.0, 2.0), "p50")
    assert row.stockout_days == 6 and row.stockout_rate == pytest.approx(6 / 7)


def test_no_stockout_when_the_upper_quantile_covers_demand(spark):
    row = outcome(merged(spark, 7, 2, 1.0, 5.0), "p90")
    assert row.stockout_days == 0 and row.holding_cost > 0


def test_holding_cost_of_one_day(spark):
    assert outcome(merged(spark, 1, 4, 10.0, 10.0), "p50").holding_cost == pytest.approx(6 * 8 * 0.20 / 365)


def test_stock_carries_over_and_is_never_lowered(spark):
    assert outcome(merged(spark, 14, 0, 10.0, 10.0), "p50").holding_cost == pytest.approx(14 * 70 * 8 * 0.20 / 365)


def test_careful_policy_is_never_worse(spark):
    both = merged(spark, 28, 6, 5.0, 9.0).union(merged(spark, 28, 6, 5.0, 9.0, sid="B"))
    summary = {r.policy: r for r in policy.policy_summary(policy.policy_per_series(policy.inventory_trace(both))).collect()}
    assert summary["p90"].mean_stockout_rate <= summary["p50"].mean_stockout_rate and summary["p50"].n_series == 2


def test_closed_form_against_a_day_by_day_loop(spark):
    rng = np.random.default_rng(5)
    rows, expected = [], {}
    for s in range(60):
        n = int(rng.integers(1, 40))
        demand, target = rng.poisson(4, n), rng.integers(-8, 40, n) / 4
        stock, out = 0.0, []
        for d in range(n):
            if d % 7 == 0:
                stock = max(stock, target[d : d + 7].sum())
            short = demand[d] > stock
            stock = max(stock - demand[d], 0.0)
            out.append((int(short), stock))
        expected[f"S{s}"] = out
        rows += [(f"S{s}", d, int(demand[d]), 1.0, 0.0, float(target[d]), 0.0) for d in range(n)]
    trace = policy.inventory_trace(spark.createDataFrame(rows, SCHEMA), {"p50": "q50"}).orderBy("id", "d_num").collect()
    got = {}
    for r in trace:
        got.setdefault(r.id, []).append((r.stockout, r.inv_after))
    assert got.keys() == expected.keys()
    for sid in expected:
        assert got[sid] == [(a, pytest.approx(b)) for a, b in expected[sid]]


def test_negative_demand_fails_loudly(spark):
    with pytest.raises(Exception, match="neither negative nor missing"):
        policy.inventory_trace(merged(spark, 3, -1, 1.0, 1.0)).collect()
