"""A count model across all series: a log-linear mean over the last days and static covariates, and sampled paths of its future."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallycast.functions.names import HORIZON, QUANTILES, SEASON
from tallycast.functions.quantiles import repair_quantiles
from tallycast.operators.features import by_day
from tallycast.operators.forecasters import FORECAST_COLUMNS

MEMORY = 28  # days that the mean looks back
LAGS = (1, 7, 28)
MEANS = (7, 28)
TERMS = [*[f"log_lag_{n}" for n in LAGS], *[f"log_mean_{n}" for n in MEANS], "log_scale", "snap", *[f"wday_{d}" for d in range(2, SEASON + 1)]]


@dataclass
class CountModel:
    """Coefficients of :data:`TERMS` and of the states, the intercept, and the dispersion: variance = mean + dispersion * mean ** 2."""

    coefficients: dict[str, float]
    states: dict[str, float]
    intercept: float
    dispersion: float
    horizon: int = HORIZON


def count_terms(panel: DataFrame, last_day: int) -> DataFrame:
    """The rows of ``panel`` that have ``MEMORY`` earlier rows, with a column per term. The scale is the mean of a series up to ``last_day``.

    Terms of a row come from earlier rows of the series and from the calendar of its own day, so they are known a day ahead.
    """
    before = lambda n: F.avg("sales").over(by_day().rowsBetween(-n, -1))
    terms = {f"log_lag_{n}": F.log1p(F.lag("sales", n).over(by_day()).cast("double")) for n in LAGS}
    terms |= {f"log_mean_{n}": F.log1p(before(n)) for n in MEANS}
    scale = F.avg(F.when(F.col("d_num") <= last_day, F.col("sales"))).over(W.partitionBy("id"))
    terms["log_scale"] = F.log1p(F.coalesce(scale, F.lit(0.0)))
    terms["snap"] = F.col("snap").cast("double")
    terms |= {f"wday_{d}": (F.col("wday") == d).cast("double") for d in range(2, SEASON + 1)}
    seen = F.count("sales").over(by_day().rowsBetween(-MEMORY, -1))
    return panel.withColumns({**terms, "n_before": seen}).where(F.col("n_before") == MEMORY).drop("n_before")


def _log_mean(model: CountModel) -> Column:
    states = F.coalesce(*[F.when(F.col("state_id") == name, F.lit(value)) for name, value in sorted(model.states.items())], F.lit(0.0))
    return sum((F.lit(model.coefficients[t]) * F.col(t) for t in TERMS), F.lit(model.intercept)) + states


def one_step_mean(model: CountModel, terms: DataFrame) -> DataFrame:
    """``terms`` with the mean demand of each row's own day."""
    return terms.withColumn("mean", F.exp(_log_mean(model)))


def fit_counts(engineered: DataFrame, origin_day: int, lookback_days: int = 365, horizon: int = HORIZON, fit_ids: DataFrame | None = None) -> CountModel:
    """Poisson regression with a log link on the rows of the lookback up to ``origin_day``, of all series or of the sample ``fit_ids``.

    The mean of a negative binomial is estimated consistently by the Poisson equations; its dispersion follows by moments. The most frequent state is
    the base of the others, and a state that was not seen counts like it. Nothing after the origin is read.
    """
    chosen = engineered if fit_ids is None else engineered.join(fit_ids.select("id"), "id", "left_semi")
    visible = chosen.where(F.col("d_num") <= origin_day)
    rows = count_terms(visible, origin_day).where((F.col("d_num") > origin_day - lookback_days) & F.col("sales").isNotNull())
    # The states of a country: a handful of labels.
    states = [r.state_id for r in rows.groupBy("state_id").count().orderBy(F.desc("count"), "state_id").collect() if r.state_id is not None][1:]
    indicators = [F.coalesce((F.col("state_id") == s).cast("double"), F.lit(0.0)) for s in states]
    data = rows.select("id", F.col("sales").cast("double").alias("sales"), array_to_vector(F.array(*TERMS, *indicators)).alias("terms"))
    data = data.checkpoint() if data.sparkSession.sparkContext.getCheckpointDir() else data
    fit = GeneralizedLinearRegression(
        family="poisson", link="log", featuresCol="terms", labelCol="sales", predictionCol="mean", regParam=1e-6, maxIter=50).fit(data)
    found = [float(x) for x in fit.coefficients]
    return CountModel(
        dict(zip(TERMS, found)), dict(zip(states, found[len(TERMS):])), float(fit.intercept), dispersion(fit.transform(data)), horizon)


def dispersion(rows: DataFrame) -> float:
    """What the variance of ``sales`` has beyond its ``mean``, in units of the squared mean; zero if it has less."""
    excess = F.sum((F.col("sales") - F.col("mean")) ** 2 - F.col("mean"))
    return float(rows.agg(F.greatest(F.coalesce(F.try_divide(excess, F.sum(F.col("mean") ** 2)), F.lit(0.0)), F.lit(0.0))).first()[0])


def sampled_paths(model: CountModel, engineered: DataFrame, origin_day: int, n_paths: int = 200, seed: int = 42) -> DataFrame:
    """``[origin, id, d_num, draws]``: per series and future day one count for each of ``n_paths`` futures.

    A path is drawn day by day: the mean follows from the last 28 days, among them the draws before, and the draw is negative
    binomial. Random numbers belong to series, origin and seed, so partitioning does not change them. ``engineered`` must hold
    the calendar of the days to come; their sales are ignored. Series with fewer than 28 rows up to the origin are absent.
    """
    point = F.struct("d_num", F.col("sales").cast("double").alias("sales"))
    past = F.col("d_num") <= origin_day
    ahead = F.struct("d_num", "wday", "snap")
    series = engineered.where(F.col("d_num") <= origin_day + model.horizon).groupBy("id").agg(
        F.avg(F.when(past, F.col("sales"))).alias("scale"), F.first("state_id").alias("state_id"),
        F.sort_array(F.collect_list(F.when(past & (F.col("d_num") > origin_day - 4 * MEMORY), point)), asc=False).alias("past"),
        F.sort_array(F.collect_list(F.when(~past, ahead))).alias("ahead"))
    ready = series.where((F.size("past") >= MEMORY) & (F.size("ahead") > 0)).select(
        "id", "scale", "state_id", F.slice("past", 1, MEMORY)["sales"].alias("recent"), F.col("ahead.d_num").alias("days"),
        F.col("ahead.wday").alias("wdays"), F.col("ahead.snap").alias("snaps"))

    def draw(batches):
        import zlib

        import numpy as np
        import pandas as pd

        b, shape = model.coefficients, 1 / model.dispersion if model.dispersion > 0 else None
        weekday = np.array([0.0, 0.0, *[b[f"wday_{d}"] for d in range(2, SEASON + 1)]])
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                fixed = model.intercept + b["log_scale"] * np.log1p(part["scale"].to_numpy()) + np.array([model.states.get(s, 0.0) for s in part["state_id"]])
                randoms = [np.random.default_rng([zlib.crc32(i.encode()), origin_day, seed]) for i in part["id"]]
                steps = max(map(len, part["days"]))
                gammas = [g.gamma(shape, model.dispersion, (steps, n_paths)) if shape else np.ones((steps, n_paths)) for g in randoms]
                # Newest day first, so that lag n is row n - 1.
                recent = np.repeat(np.stack(part["recent"].to_numpy()).T[:, :, None], n_paths, axis=2)
                top = 3 * recent.max(axis=0) + 10
                draws = np.zeros((len(part), steps, n_paths))
                for h in range(steps):
                    calendar = np.array([weekday[w[h]] + b["snap"] * s[h] if h < len(w) else 0.0 for w, s in zip(part["wdays"], part["snaps"])])
                    total = (fixed + calendar)[:, None] + sum(b[f"log_lag_{n}"] * np.log1p(recent[n - 1]) for n in LAGS)
                    total = total + sum(b[f"log_mean_{n}"] * np.log1p(recent[:n].mean(axis=0)) for n in MEANS)
                    mean = np.minimum(np.exp(np.minimum(total, 50)), top)
                    for i, g in enumerate(randoms):
                        draws[i, h] = g.poisson(mean[i] * gammas[i][h])
                    recent = np.concatenate([draws[None, :, h], recent[:-1]])
                yield pd.DataFrame({
                    "origin": origin_day, "id": np.repeat(part["id"].to_numpy(), [len(d) for d in part["days"]]),
                    "d_num": np.concatenate(part["days"].to_list()),
                    "draws": [draws[i, h] for i, days in enumerate(part["days"]) for h in range(len(days))]})

    return ready.mapInPandas(draw, "origin long, id string, d_num long, draws array<double>")


def forecast_counts(model: CountModel, engineered: DataFrame, origin_day: int, n_paths: int = 200, seed: int = 42) -> DataFrame:
    """Quantiles over the sampled paths."""
    paths = sampled_paths(model, engineered, origin_day, n_paths, seed).withColumn("draws", F.sort_array("draws"))
    at = lambda level: F.col("draws")[min(int(level * n_paths), n_paths - 1)]
    return repair_quantiles(paths.withColumns({name: at(level) for name, level in QUANTILES.items()})).select(*FORECAST_COLUMNS)
