"""Damped additive Holt-Winters with simulated quantiles for all series.

Spark gathers each series into one row. Inside a task the recursion runs over many series and all
smoothing settings at once, so a Python step costs one array operation per day and not one per series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallycast.functions.names import HORIZON, SEASON
from tallycast.functions.quantiles import repair_quantiles
from tallycast.operators.forecasters import FORECAST_COLUMNS, FORECAST_SCHEMA, series_arrays


def holt_winters(
    history: DataFrame, origins: list[int], horizon: int = HORIZON, n_sims: int = 200, seed: int = 42,
    min_cycles: int = 2, season: int = SEASON, series_per_step: int = 256,
) -> DataFrame:
    """Quantiles over ``n_sims`` simulated paths per series and origin; short series are absent.

    One pass over a series serves every origin: squared errors and states are taken as they stand at
    each origin, and the smoothing setting with the least squared error up to there is used. The random
    numbers depend on series, origin and seed only, not on how rows are partitioned.
    """

    def forecast_chunk(ids, days, sales):
        import itertools
        import zlib

        import numpy as np
        import pandas as pd

        grid = np.array(list(itertools.product((0.05, 0.2, 0.5), (0.0, 0.02), (0.05, 0.2), (0.9, 0.98))))
        alpha, beta, gamma, phi = grid.T
        lengths = np.array([len(s) for s in sales])
        y = np.zeros((len(ids), lengths.max()))
        for i, s in enumerate(sales):
            y[i, : len(s)] = s
        seen = np.array([[np.searchsorted(d, o, side="right") for o in origins] for d in days])
        due = {}
        for i, row in enumerate(seen):
            for j, n in enumerate(row):
                if n >= min_cycles * season:
                    due.setdefault(int(n), []).append((i, j))
        if not due:
            return None

        first, second = y[:, :season], y[:, season : 2 * season]
        ones = np.ones(len(grid))
        level = first.mean(axis=1)[:, None] * ones
        trend = ((second.mean(axis=1) - first.mean(axis=1)) / season)[:, None] * ones
        cycle = (first - first.mean(axis=1)[:, None]).T[:, :, None] * ones
        sse = np.zeros_like(level)
        fits = []
        for t in range(season, max(due)):
            damped, s = phi * trend, t % season
            error = y[:, t : t + 1] - (level + damped + cycle[s])
            sse += error * error
            level = level + damped + alpha * error
            trend = damped + beta * error
            cycle[s] += gamma * error
            for i, j in due.get(t + 1, ()):
                best = int(np.argmin(sse[i]))
                sigma = np.sqrt(sse[i, best] / (t + 1 - season))
                fits.append((i, j, best, t + 1, level[i, best], trend[i, best], cycle[:, i, best].copy(), sigma))

        who, at, best, n, lev, tre, cyc, sigma = (np.array(part) for part in zip(*fits))
        noise = np.stack([
            np.random.default_rng([zlib.crc32(ids[i].encode()), origins[j], seed]).standard_normal((horizon, n_sims))
            for i, j in zip(who, at)
        ]) * sigma[:, None, None]
        column = lambda v: v[:, None] * np.ones(n_sims)
        lev, tre = column(lev), column(tre)
        cyc = cyc[:, :, None] * np.ones(n_sims)
        a, b, g, p = (grid[best, k][:, None] for k in range(4))
        rows, paths = np.arange(len(who)), np.empty_like(noise)
        for h in range(horizon):
            s = (n + h) % season
            damped, error = p * tre, noise[:, h]
            paths[:, h] = lev + damped + cyc[rows, s] + error
            lev, tre = lev + damped + a * error, damped + b * error
            cyc[rows, s] += g * error
        q10, q50, q90 = np.quantile(paths, (0.1, 0.5, 0.9), axis=2)
        origin = np.array(origins)[at]
        return pd.DataFrame({
            "origin": np.repeat(origin, horizon),
            "id": np.repeat(np.array(ids, dtype=object)[who], horizon),
            "d_num": (origin[:, None] + np.arange(1, horizon + 1)).ravel(),
            "q10": q10.ravel(), "q50": q50.ravel(), "q90": q90.ravel(),
        })

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), series_per_step):
                part = batch.iloc[start : start + series_per_step]
                out = forecast_chunk(part["id"].tolist(), part["days"].tolist(), part["sales"].tolist())
                if out is not None:
                    yield out

    arrays = series_arrays(history, origins).select(
        "id", F.col("points.d_num").alias("days"), F.col("points.sales").alias("sales")
    )
    long_enough = arrays.where(F.size("days") >= min_cycles * season)
    return repair_quantiles(long_enough.mapInPandas(run, FORECAST_SCHEMA)).select(*FORECAST_COLUMNS)
