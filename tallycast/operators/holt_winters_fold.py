"""Damped additive Holt-Winters as a fold over the days of a series, with bands in closed form. Everything stays in Spark's own expressions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from tallycast.functions.names import HORIZON, SEASON
from tallycast.functions.quantiles import repair_quantiles
from tallycast.operators.forecasters import FORECAST_COLUMNS, Z80, rows_seen, series_arrays

#: Smoothing of level, trend and cycle, and the damping of the trend.
SETTINGS = tuple(itertools.product((0.05, 0.2, 0.5), (0.0, 0.02), (0.05, 0.2), (0.9, 0.98)))
STATE = ["n", "setting", "level", "trend", "cycle", "sse"]


def _folded(points: Column, seen: Column, setting: Column, season: int) -> Column:
    """The states of one setting at all numbers of rows in ``seen``: array of (n, sse, setting, level, trend, cycle).

    The cycle is a queue: its head belongs to the next day. A state is kept where the rows seen by an origin end.
    """
    number = lambda x: F.lit(x).cast("double")
    mean = lambda values: F.aggregate(values, number(0), lambda total, v: total + v) / season
    first, second = F.slice(points, 1, season), F.slice(points, season + 1, season)
    kept = F.array().cast("array<struct<n:int,sse:double,setting:int,level:double,trend:double,cycle:array<double>>>")
    start = F.struct(
        F.lit(season).alias("n"), number(0).alias("sse"), mean(first).alias("level"), ((mean(second) - mean(first)) / season).alias("trend"),
        F.transform(first, lambda v: v - mean(first)).alias("cycle"), kept.alias("kept"))

    def after(state: Column, y: Column) -> Column:
        error = y - (state["level"] + setting["phi"] * state["trend"] + state["cycle"][0])
        n, sse = (state["n"] + 1).cast("int"), state["sse"] + error * error
        level = state["level"] + setting["phi"] * state["trend"] + setting["alpha"] * error
        trend = setting["phi"] * state["trend"] + setting["beta"] * error
        cycle = F.concat(F.slice(state["cycle"], 2, season - 1), F.array(state["cycle"][0] + setting["gamma"] * error))
        snapshot = F.struct(
            n.alias("n"), sse.alias("sse"), setting["setting"].alias("setting"), level.alias("level"), trend.alias("trend"), cycle.alias("cycle"))
        return F.struct(
            n.alias("n"), sse.alias("sse"), level.alias("level"), trend.alias("trend"), cycle.alias("cycle"),
            F.when(F.array_contains(seen, n), F.concat(state["kept"], F.array(snapshot))).otherwise(state["kept"]).alias("kept"))

    days = F.slice(points, season + 1, F.greatest(F.array_max(seen) - season, F.lit(0)))
    return F.aggregate(days, start, after, lambda state: state["kept"])


def holt_winters_state(history: DataFrame, origins: list[int], season: int = SEASON, min_cycles: int = 2, settings=SETTINGS) -> DataFrame:
    """``[origin, id, n, setting, level, trend, cycle, sse]``: the state after the last row each origin sees, of the setting with the least
    squared error up to there, the earlier setting at a tie. ``cycle`` begins with the day after. Series with less than two cycles are absent.

    One row per series holds its days in order; each setting folds them once, whatever the number of origins.
    """
    grid = F.array(*[
        F.struct(F.lit(i).alias("setting"), *[F.lit(float(v)).alias(name) for name, v in zip(("alpha", "beta", "gamma", "phi"), values)])
        for i, values in enumerate(settings)])
    whole = series_arrays(history, origins, *rows_seen(origins)).select(
        "id", F.col("points.sales").alias("y"), F.filter("seen", lambda s: s["n"] >= min_cycles * season).alias("seen")).where(F.size("seen") > 0)
    lengths = F.transform("seen", lambda s: s["n"].cast("int"))
    folded = whole.select("id", "seen", F.flatten(F.transform(grid, lambda g: _folded(F.col("y"), lengths, g, season))).alias("states"))
    best = F.transform("seen", lambda s: F.struct(s["origin"].alias("origin"), F.array_min(F.filter("states", lambda x: x["n"] == s["n"])).alias("state")))
    each = folded.select("id", F.explode(best).alias("best"))
    return each.select("best.origin", "id", *[F.col(f"best.state.{c}").alias(c) for c in STATE])


def holt_winters_bands(
    history: DataFrame, origins: list[int], horizon: int = HORIZON, season: int = SEASON, min_cycles: int = 2, settings=SETTINGS,
) -> DataFrame:
    """Forecasts whose P10 and P90 follow from the known variance of the damped additive model.

    A shock moves the j-th later day by ``alpha + beta * (phi + .. + phi ** j)``, plus ``gamma`` on the same day of the cycle; the
    variance at step h is that of a shock times one plus the sum of these squares for j below h.
    """
    state = holt_winters_state(history, origins, season, min_cycles, settings)
    rows = []
    for i, (alpha, beta, gamma, phi) in enumerate(settings):
        damped, spread = 0.0, 1.0
        for h in range(1, horizon + 1):
            damped += phi**h
            rows.append((i, h, damped, spread))
            spread += (alpha + beta * damped + (gamma if h % season == 0 else 0.0)) ** 2
    # One row per setting and step: a table of fixed size.
    steps = state.sparkSession.createDataFrame(rows, "setting int, h int, damped double, spread double")
    ahead = state.join(F.broadcast(steps), "setting")
    point = F.col("level") + F.col("damped") * F.col("trend") + F.element_at("cycle", (F.col("h") - 1) % season + 1)
    sigma = F.sqrt(F.col("sse") / (F.col("n") - season) * F.col("spread"))
    raw = ahead.select(
        "origin", "id", (F.col("origin") + F.col("h")).cast("long").alias("d_num"),
        (point - Z80 * sigma).alias("q10"), point.alias("q50"), (point + Z80 * sigma).alias("q90"))
    return repair_quantiles(raw).select(*FORECAST_COLUMNS)
