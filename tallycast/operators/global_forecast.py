"""One model trained across all series: boosted trees over scaled demand, quantiles from the training targets in their leaves."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor, wait, FIRST_EXCEPTION
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from tallycast.functions.names import (
    CALENDAR_CATEGORICALS, CALENDAR_REALS, HORIZON, PRICE_REALS, QUANTILES, STATIC_CATEGORICALS, rolling_feature_names,
)
from tallycast.functions.quantiles import nearest_of_sorted, repair_quantiles
from tallycast.operators.features import add_lag_features
from tallycast.operators.forecasters import FORECAST_COLUMNS
from tallycast.operators.training_data import horizon_rows, origin_panels
from tallycast.session import scratch_path, use_checkpoints

# Covariates of the target day that a caller may add: all of them come from the calendar alone.
AHEAD_REALS = ["wday", "month", "snap"]
AHEAD_CATEGORICALS = ["event_name_1", "event_type_1"]
MISSING = -1.0


# A leaf's targets are kept as so many quantiles, so the table of leaves has trees * 2 ** depth * LEAF_POINTS numbers at most.
LEAF_POINTS = 50
TREES, DEPTH, RATE, TOLERANCE = 20, 5, 0.3, 0.001


@dataclass
class GlobalModel:
    """A fitted pipeline, the targets of its leaves and the feature choice behind it.

    ``leaves`` has one row per tree and leaf: the number of training windows in it and quantiles ``points`` of their scaled targets.
    """

    pipeline: PipelineModel
    leaves: DataFrame
    use_lags: bool
    horizon: int
    use_ahead: bool = False


def _categoricals(use_ahead: bool) -> list[str]:
    return [*STATIC_CATEGORICALS, *CALENDAR_CATEGORICALS, *([f"t_{c}" for c in AHEAD_CATEGORICALS] if use_ahead else [])]


def _numerics(use_lags: bool, use_ahead: bool) -> list[str]:
    own = [*CALENDAR_REALS, *PRICE_REALS, "coldstart_flag", *rolling_feature_names(), "h"]
    return own + ([f"t_{c}" for c in AHEAD_REALS] if use_ahead else []) + (["lag_7", "lag_28"] if use_lags else [])


def _prepared(rows: DataFrame, use_lags: bool, use_ahead: bool) -> DataFrame:
    """Trees split on values, so a missing number becomes one of its own."""
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in _numerics(use_lags, use_ahead)})


def _with_lags(engineered: DataFrame, use_lags: bool) -> DataFrame:
    """The target lags; a table that stores them already is left as it is, so that a day filter reaches its scan."""
    return add_lag_features(engineered) if use_lags and "lag_7" not in engineered.columns else engineered


def _ahead(use_ahead: bool) -> tuple[str, ...]:
    return tuple(AHEAD_REALS + AHEAD_CATEGORICALS) if use_ahead else ()


def residual_bands(residuals: DataFrame, *keys: str) -> DataFrame:
    """The 0.1 and 0.9 quantiles ``low`` and ``high`` of the column ``residual`` per group."""
    bands = residuals.groupBy(*keys).agg(F.percentile_approx("residual", [0.1, 0.9], 10_000).alias("band"))
    return bands.select(*keys, F.col("band")[0].alias("low"), F.col("band")[1].alias("high"))


def predict_rows(engineered: DataFrame, origin_day: int, horizon: int = HORIZON, use_ahead: bool = False, use_lags: bool = True) -> DataFrame:
    """One row per series and step from the features of the origin day; sales after the origin are hidden."""
    blind = engineered.withColumn("sales", F.when(F.col("d_num") <= origin_day, F.col("sales")))
    recent = _with_lags(blind, use_lags).where(F.col("d_num").between(origin_day, origin_day + horizon))
    return horizon_rows(recent, horizon, _ahead(use_ahead), keep_unknown=True, where=F.col("d_num") == origin_day)


def _noise_scale() -> Column:
    """Spread grows with the level of a series like that of a count. Trees see demand in this unit."""
    return F.sqrt(F.greatest(F.coalesce("rolling_mean_28", F.lit(0.0)), F.lit(0.0)) + 1)


def assemble(
    engineered: DataFrame, origins: list[int], horizon: int = HORIZON, stride: int = 7, lookback_days: int = 180, use_lags: bool = True,
    use_ahead: bool = False, fit_ids: DataFrame | None = None,
) -> tuple[DataFrame, list]:
    """The training windows of all origins as one written table, and the fitted feature stages.

    Every window carries the ``origin`` it serves, ``features``, the scaled target and ``held_out``. History is read and shuffled once for
    all origins. Categories are indexed on rows up to the earliest origin; what comes later falls into the unknown bucket.
    """
    chosen = engineered if fit_ids is None else engineered.join(fit_ids.select("id"), "id", "left_semi")
    visible = _with_lags(chosen.where(F.col("d_num") <= max(origins)), use_lags)
    panel = origin_panels(visible, origins, horizon, stride, lookback_days, _ahead(use_ahead))
    held = reduce(lambda tail, o: F.when(F.col("origin") == o, held_out_windows(o, horizon)).otherwise(tail), origins, F.lit(None))
    rows = _prepared(panel.withColumn("scale", _noise_scale()), use_lags, use_ahead).withColumn("held_out", held).where("held_out is not null")
    categoricals = _categoricals(use_ahead)
    codes = [f"{c}_code" for c in categoricals]
    features = Pipeline(
        stages=[
            StringIndexer(inputCols=categoricals, outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep"),
            VectorAssembler(inputCols=codes + _numerics(use_lags, use_ahead), outputCol="features"),
        ]
    ).fit(_prepared(_history_rows(visible.where(F.col("d_num") <= min(origins)), use_ahead), use_lags, use_ahead))
    scaled = features.transform(rows).select("origin", "features", (F.col("target") / F.col("scale")).alias("target"), "held_out")
    path = scratch_path(engineered.sparkSession, "windows")
    scaled.write.partitionBy("origin").parquet(path)
    return engineered.sparkSession.read.parquet(path), features.stages


def fit_trees(windows: DataFrame, stages: list, trees: int = TREES, depth: int = DEPTH, learning_rate: float = RATE, seed: int = 42):
    """Boosted trees on assembled windows and the table of their leaves.

    The held-out windows stop the boosting once a further tree gains less than a thousandth of their error.
    """
    most_values = max(len(labels) for labels in stages[0].labelsArray) + 1
    model = GBTRegressor(
        featuresCol="features", labelCol="target", predictionCol="point", leafCol="leaf_ids", lossType="absolute",
        maxIter=trees, maxDepth=depth, stepSize=learning_rate, maxBins=max(32, most_values), seed=seed,
        validationIndicatorCol="held_out", validationTol=TOLERANCE, checkpointInterval=10,
    ).fit(windows)
    return model, leaf_targets(model.transform(windows))


def leaf_targets(predicted: DataFrame) -> DataFrame:
    """``[tree, leaf, n, points]``: per tree and leaf the windows that fall into it and evenly spaced quantiles of their targets."""
    each = predicted.select(F.posexplode(vector_to_array("leaf_ids")).alias("tree", "leaf"), "target")
    levels = [(i + 0.5) / LEAF_POINTS for i in range(LEAF_POINTS)]
    return each.groupBy("tree", F.col("leaf").cast("int").alias("leaf")).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("target", levels, 10_000).alias("points"))


def fit_global(
    engineered: DataFrame, origin_day: int, horizon: int = HORIZON, stride: int = 7, lookback_days: int = 180,
    use_lags: bool = True, trees: int = TREES, depth: int = DEPTH, learning_rate: float = RATE, seed: int = 42,
    use_ahead: bool = False, fit_ids: DataFrame | None = None,
) -> GlobalModel:
    """Train on the candidate origins up to ``origin_day``, of all series or of the bounded sample ``fit_ids``.

    The last candidate windows are held out to stop the boosting. All their targets lie after every target that is trained on; windows that
    would overlap both are left out. Nothing after ``origin_day`` is read. Only features of the candidate day enter, unless
    ``use_ahead`` adds the calendar of the target day. Demand is divided by the noise scale of its series, so that trees are few.
    """
    return fit_origins(engineered, [origin_day], horizon, stride, lookback_days, use_lags, trees, depth, learning_rate, seed, use_ahead, fit_ids)[origin_day]


def fit_origins(
    engineered: DataFrame, origins: list[int], horizon: int = HORIZON, stride: int = 7, lookback_days: int = 180,
    use_lags: bool = True, trees: int = TREES, depth: int = DEPTH, learning_rate: float = RATE, seed: int = 42,
    use_ahead: bool = False, fit_ids: DataFrame | None = None,
) -> dict[int, GlobalModel]:
    """A model for every origin, from one table of windows. The fits run at the same time, each in a scheduler pool of its own.

    A model sees only the windows of its own origin. The first fit that fails cancels the others' job group.
    """
    spark = engineered.sparkSession
    use_checkpoints(spark)
    windows, stages = assemble(engineered, origins, horizon, stride, lookback_days, use_lags, use_ahead, fit_ids)
    group = scratch_path(spark, "fits").rsplit("/", 1)[-1]

    def fit(origin: int) -> GlobalModel:
        spark.sparkContext.setJobGroup(group, f"global model at {origin}", interruptOnCancel=True)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"origin-{origin}")
        own = windows.where(F.col("origin") == origin).drop("origin")
        model, leaves = fit_trees(own, stages, trees, depth, learning_rate, seed)
        path = scratch_path(spark, "leaves")
        leaves.write.parquet(path)
        return GlobalModel(PipelineModel([*stages, model]), spark.read.parquet(path), use_lags, horizon, use_ahead)

    with ThreadPoolExecutor(max_workers=len(origins)) as pool:
        jobs = {o: pool.submit(inheritable_thread_target(spark)(fit), o) for o in origins}
        done, _ = wait(jobs.values(), return_when=FIRST_EXCEPTION)
        if any(job.exception() for job in done):
            spark.sparkContext.cancelJobGroup(group)
    return {o: job.result() for o, job in jobs.items()}


def held_out_windows(origin_day: int, horizon: int = HORIZON) -> Column:
    """True for the windows after two horizons before the origin, false for those a horizon earlier, NULL between."""
    day = F.col("d_num")
    return F.when(day > origin_day - 2 * horizon, True).when(day <= origin_day - 3 * horizon, False)


def _history_rows(visible: DataFrame, use_ahead: bool) -> DataFrame:
    """Rows on which the categories are indexed: each history row once, its own day standing for a target day."""
    ahead = {f"t_{c}": F.col(c) for c in _ahead(use_ahead)}
    return visible.withColumns({**ahead, "h": F.lit(1)})


def leaf_quantiles(model: GlobalModel, rows: DataFrame, levels: dict[str, float]) -> DataFrame:
    """``rows`` with a column per level: the quantile of the training targets that share the row's leaves.

    Every tree adds the targets of one leaf and all trees weigh the same, so a target weighs the more the smaller its leaf. The table of leaves has a
    size fixed by trees, depth and points; it is one broadcast row of arrays, looked up by tree and leaf.
    """
    by_tree = model.leaves.groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "points"))).alias("found"), F.max("leaf").alias("last"))
    as_array = F.transform(F.sequence(F.lit(0), F.col("last")), lambda leaf: F.try_element_at("found", leaf))
    every = by_tree.agg(F.array_sort(F.collect_list(F.struct("tree", as_array.alias("leaves")))).alias("forest")).select(F.col("forest.leaves").alias("forest"))
    predicted = model.pipeline.transform(_prepared(rows, model.use_lags, model.use_ahead))
    own = F.zip_with(vector_to_array("leaf_ids"), "forest", lambda leaf, leaves: F.coalesce(F.try_element_at(leaves, leaf.cast("int") + 1), F.array()))
    shared = predicted.join(F.broadcast(every)).withColumn("shared", F.sort_array(F.flatten(own)))
    return shared.withColumns({name: nearest_of_sorted(F.col("shared"), level) * _noise_scale() for name, level in levels.items()}).drop("shared", "forest")


def forecast_global(model: GlobalModel, engineered: DataFrame, origin_day: int) -> DataFrame:
    """Forecast from any origin with a fitted model, without refitting.

    ``engineered`` must reach ``horizon`` rows past the origin with known covariates; sales there are
    ignored, and unknown values of a category fall into its unknown bucket.
    """
    return repair_quantiles(quantile_forecast(model, engineered, origin_day, QUANTILES)).select(*FORECAST_COLUMNS)


def quantile_forecast(model: GlobalModel, engineered: DataFrame, origin_day: int, levels: dict[str, float]) -> DataFrame:
    """``[origin, id, d_num, *levels]`` for the days after ``origin_day``, by the leaves of all trees; never below zero and in order of the levels."""
    rows = predict_rows(engineered, origin_day, model.horizon, model.use_ahead, model.use_lags)
    out = leaf_quantiles(model, rows, levels)
    return out.select(
        F.lit(origin_day).cast("long").alias("origin"), "id", F.col("target_day").cast("long").alias("d_num"),
        *[F.greatest(F.col(name), F.lit(0.0)).alias(name) for name in levels])


def backtest_global(engineered: DataFrame, origins: list[int], **settings) -> DataFrame:
    """Forecasts of all origins by a model of their own: a model never sees a row after its origin. ``engineered`` should be a written table."""
    models = fit_origins(engineered, origins, **settings)
    return reduce(DataFrame.unionByName, [forecast_global(models[o], engineered, o) for o in origins])


def save_global(model: GlobalModel, path: str) -> None:
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    model.leaves.write.mode("overwrite").parquet(f"{path}/leaves")
    choices = {"use_lags": model.use_lags, "horizon": model.horizon, "use_ahead": model.use_ahead}
    model.leaves.sparkSession.createDataFrame([(json.dumps(choices),)], "choices string").write.mode("overwrite").parquet(f"{path}/choices")


def load_global(spark, path: str) -> GlobalModel:
    choices = json.loads(spark.read.parquet(f"{path}/choices").first().choices)
    return GlobalModel(PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/leaves"), **choices)
