"""Every operator as a runnable query over the given tables. Keys match :mod:`tallycast.catalog.oracle`."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tallycast.catalog.workspace import Workspace
from tallycast.functions.losses import pinball
from tallycast.functions.names import (
    CALENDAR_CATEGORICALS, CALENDAR_COLUMNS, HORIZON, ID_COLUMNS, QUANTILES, STATIC_CATEGORICALS,
)
from tallycast.functions.quantiles import exact_quantile, repair_quantiles
from tallycast.operators import coldstart, count_forecast as counts, dictionary, features, forecasters, ingest, metrics, policy, reshape, training_data
from tallycast.operators.global_forecast import (
    backtest_global, forecast_global, held_out_windows, predict_rows, quantile_forecast, residual_bands as global_bands,
)
from tallycast.operators.holt_winters import holt_winters as holt_winters_forecast
from tallycast.operators.holt_winters_fold import holt_winters_bands as closed_bands, holt_winters_state as folded_state
from tallycast.operators.origins import generate_origins, origins_table
from tallycast.operators.sampling import stratified_sample
from tallycast.plans import backtest, reports
from tallycast.session import scratch_path
from tallycast.sources import demand, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL_MODELS = {"seasonal_naive": forecasters.seasonal_naive, "trend_weekly": forecasters.trend_weekly}


def query(build: Callable[[Workspace], DataFrame]):
    """Register a query under its function name; doubles are rounded so that two engines can be compared."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build(Workspace(spark, sf_dir))
        return out.select(*[
            (F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in out.dtypes
        ])

    QUERIES[build.__name__] = run
    return build


def origins_of(ws: Workspace) -> list[int]:
    return generate_origins(ws.days()["val"])


# --- sources and ingest -------------------------------------------------------------------------------


@query
def daily_demand(ws):
    return demand.daily_demand(ws.spark, ws.sf_dir).drop("r_name")


@query
def daily_demand_coarse(ws):
    return demand.coarse_demand(demand.daily_demand(ws.spark, ws.sf_dir)).drop("r_name")


@query
def calendar_dim(ws):
    return ws.calendar()


@query
def sell_prices(ws):
    return ws.prices("fine")


@query
def scan_csv(ws):
    """The three raw tables written as CSV, scanned again and taken through the whole ingest."""
    root = scratch_path(ws.spark, "raw")
    wide = demand.sales_wide(ws.long("fine"), ws.days()["test"])
    sales = tables.scan_sales_wide(ws.spark, tables.write_csv(wide, f"{root}/sales"))
    calendar = tables.scan_calendar(ws.spark, tables.write_csv(ws.calendar(), f"{root}/calendar"))
    prices = tables.scan_prices(ws.spark, tables.write_csv(ws.prices("fine"), f"{root}/prices"))
    return ingest.build_panel(ingest.melt_sales(sales), calendar, prices).select(
        "id", "d_num", "date", "sales", "sell_price", "event_name_1", "split"
    )


@query
def melt_sales(ws):
    wide = demand.sales_wide(ws.long("coarse"), ws.days()["test"])
    return ingest.melt_sales(wide)


@query
def join_calendar(ws):
    joined = ingest.join_calendar(ws.long("coarse"), ws.calendar())
    return joined.select("id", "d_num", "sales", *CALENDAR_COLUMNS)


@query
def join_prices(ws):
    joined = ingest.join_prices(ingest.join_calendar(ws.long("fine"), ws.calendar()), ws.prices("fine"))
    return joined.select("id", "d_num", "wm_yr_wk", "sell_price")


@query
def drop_pre_release(ws):
    joined = ingest.join_prices(ingest.join_calendar(ws.long("fine"), ws.calendar()), ws.prices("fine"))
    return ingest.drop_pre_release(joined).select("id", "d_num", "sales", "sell_price")


@query
def pre_release_stats(ws):
    return ingest.pre_release_stats(
        ingest.join_prices(ingest.join_calendar(ws.long("fine"), ws.calendar()), ws.prices("fine"))
    )


@query
def assign_split(ws):
    joined = ingest.join_prices(ingest.join_calendar(ws.long("fine"), ws.calendar()), ws.prices("fine"))
    return ingest.assign_split(ingest.drop_pre_release(joined)).select("id", "d_num", "split")


@query
def split_profile(ws):
    return tables.split_profile(ws.panel("fine"))


@query
def split_profile_sketched(ws):
    """The same profile from stored sketches of every split and year, read back and merged."""
    path = tables.write_parquet(tables.series_sketches(ws.panel("fine")), scratch_path(ws.spark, "sketches"))
    return tables.profile_of_sketches(ws.spark.read.parquet(path))


@query
def load_panel(ws):
    return tables.load_panel(ws.panel("coarse"), ("train", "val"), ["id", "cat_id", "d_num", "sales", "date"])


@query
def parquet_roundtrip(ws):
    path = tables.write_splits(ws.build("coarse"), scratch_path(ws.spark, "splits"))
    return ws.spark.read.parquet(path).select("id", "d_num", "sales", "sell_price", "split")


@query
def csv_roundtrip(ws):
    results = backtest.run_backtest(
        ws.trainval("coarse"), SQL_MODELS, origins_of(ws), segments(ws, "coarse"), trusted=True
    )
    path = tables.write_csv(results, scratch_path(ws.spark, "results"), single_file=True)
    return tables.read_report(ws.spark, path)


@query
def series_dim(ws):
    return ws.panel("fine").select(*ID_COLUMNS).distinct()


# --- features and series sets -------------------------------------------------------------------------


@query
def snap_flag(ws):
    return features.add_snap_flag(ws.panel("coarse")).select("id", "d_num", "snap")


@query
def price_change_flag(ws):
    return features.add_price_change_flag(ws.panel("coarse")).select(
        "id", "d_num", F.col("price_change_flag").cast("int").alias("price_change_flag")
    )


@query
def rolling_features(ws):
    return features.add_rolling_features(ws.panel("coarse")).select(
        "id", "d_num", "rolling_mean_7", "rolling_std_7", "rolling_mean_28", "rolling_std_28"
    )


@query
def lag_features(ws):
    return features.add_lag_features(ws.panel("coarse")).select("id", "d_num", "sales", "lag_7", "lag_28")


@query
def coldstart_flag(ws):
    return features.add_coldstart_flag(ws.panel("coarse")).select("id", "d_num", "coldstart_flag")


ENGINEERED = [
    "id", "d_num", "sales", "sell_price", "snap", "wday", "month", "year", "price_change_flag", "coldstart_flag",
    "rolling_mean_7", "rolling_std_7", "rolling_mean_28", "rolling_std_28",
]


@query
def engineer_features(ws):
    return features.engineer_features(ws.trainval("coarse")).select(*ENGINEERED)


@query
def engineer_features_recent(ws):
    """The bounded form: one year before the end of train, features still computed from all history."""
    min_day = ws.days()["train"] - 365
    return features.engineer_features(ws.trainval("coarse"), min_day=min_day).select(*ENGINEERED)


@query
def engineer_features_coldstart(ws):
    """The chain with a cold-start holdout: its history is cut before the first feature is computed."""
    cold = ws.cold("coarse", 0.2)
    cutoff = coldstart.coldstart_cutoff_day(ws.days()["train"])
    return features.engineer_features(ws.trainval("coarse"), cold_ids=cold, cutoff_day=cutoff).select(*ENGINEERED)


@query
def incremental_features(ws):
    """The same rows by three runs: all train days at once, then val in two halves from the stored state alone."""
    end = ws.days()["train"]
    val = ws.panel("coarse").where("split = 'val'").drop("split")
    state, parts = ws.feature_state("coarse"), [ws.train_features("coarse")]
    for low in (end, end + HORIZON // 2):
        fresh, after = features.carry_features(state, val.where(F.col("d_num").between(low + 1, low + HORIZON // 2)))
        parts.append(fresh)
        state = ws.spark.read.parquet(tables.write_parquet(after, scratch_path(ws.spark, "feature_state")))
    return reduce(DataFrame.unionByName, [part.select(*ENGINEERED, "lag_7", "lag_28") for part in parts])


@query
def restrict_series(ws):
    chosen = ws.dozen()
    return features.restrict_series(ws.panel("coarse"), chosen).select("id", "d_num", "sales")


@query
def encode_categoricals(ws):
    columns = STATIC_CATEGORICALS + CALENDAR_CATEGORICALS
    codes = training_data.fit_codes(ws.panel("coarse").where("split = 'train'"), columns)
    coded = training_data.encode_categoricals(ws.panel("coarse"), codes)
    return coded.select("id", "d_num", *[f"{c}_code" for c in columns])


@query
def encode_ids(ws):
    """Codes of the series known in train, by range partitions of their ids; half of them are left out, so that the rest is unknown."""
    train = ws.panel("fine").where("split = 'train' and length(id) % 2 = 0")
    codes = dictionary.dense_ids(train, ["id"])
    return dictionary.encode_ids(ws.panel("fine").select("id").distinct(), codes, ["id"])


@query
def encode_store_items(ws):
    """Codes of the pairs of store and item."""
    pairs = ws.panel("fine").select("store_id", "item_id").distinct()
    return dictionary.encode_ids(pairs, dictionary.dense_ids(pairs, ["store_id", "item_id"]), ["store_id", "item_id"])


@query
def stratified_sample_series(ws):
    return stratified_sample(ws.panel("fine"), 100, 42)


@query
def coldstart_sample(ws):
    return coldstart.coldstart_sample(ws.panel("fine"))


@query
def coldstart_truncate(ws):
    cold = ws.cold("coarse", 0.2)
    cutoff = coldstart.coldstart_cutoff_day(ws.days()["train"])
    return coldstart.truncate_coldstart_history(ws.panel("coarse"), cold, cutoff).select("id", "d_num", "sales")


# --- metrics ------------------------------------------------------------------------------------------


def segments(ws, grain):
    return ws.segments(grain)


def naive_scored(ws):
    panel, origins = ws.trainval("coarse"), origins_of(ws)
    return metrics.score_join(panel, forecasters.seasonal_naive(panel, origins), origins, HORIZON)


@query
def volume_segment(ws):
    return metrics.volume_segment(ws.panel("fine").where("split = 'train'"), ws.days()["train"])


@query
def exact_threshold(ws):
    """The volume threshold at several levels over the train means of all series. At a tie of ranks, double arithmetic decides."""
    means = ws.segments("fine")
    levels = [exact_quantile(means, "avg_daily_sales", x).withColumn("level", F.lit(x)) for x in (0.1, 0.5, 0.8, 0.9)]
    return reduce(DataFrame.unionByName, levels).select("level", "threshold")


@query
def resid_quantiles(ws):
    return forecasters.resid_quantiles(ws.trainval("coarse"))


@query
def repair_forecast_quantiles(ws):
    """Unrepaired bands from rolling features: some are negative, some cross their median."""
    rolled = features.add_rolling_features(ws.panel("coarse")).where("rolling_mean_7 is not null")
    raw = rolled.select(
        "id", "d_num",
        (F.col("rolling_mean_7") - 1.5 * F.col("rolling_std_7")).alias("q10"),
        F.col("rolling_mean_28").alias("q50"),
        (F.col("rolling_mean_7") + 0.5 * F.col("rolling_std_7")).alias("q90"),
    )
    return repair_quantiles(raw)


@query
def score_join(ws):
    return naive_scored(ws)


@query
def pinball_loss(ws):
    losses = [pinball(F.col("sales"), F.col(q), level).alias(f"loss_{q}") for q, level in QUANTILES.items()]
    return naive_scored(ws).select("origin", "id", "d_num", *losses)


@query
def wql(ws):
    losses = metrics.series_losses(naive_scored(ws)).withColumn("mase", F.lit(None).cast("double"))
    return losses.groupBy("origin").agg(*metrics.score_columns()[:2])


@query
def mase_scale(ws):
    return metrics.mase_scale(ws.trainval("coarse"))


def naive_losses(ws):
    return metrics.with_mase(
        metrics.series_losses(naive_scored(ws)), metrics.mase_scale_as_of(ws.trainval("coarse"), origins_of(ws))
    )


@query
def mase_per_series(ws):
    return naive_losses(ws).select("origin", "id", "scale", "mase")


@query
def mase(ws):
    return naive_losses(ws).groupBy("origin").agg(F.count("mase").alias("n_defined"), F.avg("mase").alias("mase"))


# --- forecasts ----------------------------------------------------------------------------------------


@query
def generate_origins_table(ws):
    return origins_table(ws.trainval("coarse"))


@query
def horizon_grid(ws):
    series = ws.panel("coarse").select("id").distinct().withColumn("origin", F.lit(ws.days()["train"]))
    return forecasters.horizon_grid(series)


@query
def last_pattern(ws):
    return forecasters.last_pattern(ws.trainval("coarse"))


@query
def seasonal_naive(ws):
    return forecasters.seasonal_naive(ws.trainval("coarse"), origins_of(ws))


@query
def trend_weekly(ws):
    return forecasters.trend_weekly(ws.trainval("coarse"), origins_of(ws))


@query
def holt_winters(ws):
    return holt_winters_forecast(ws.trainval("coarse"), origins_of(ws))


@query
def holt_winters_state(ws):
    """The fitted state of every series at every origin: the whole history folded under every setting."""
    state = folded_state(ws.trainval("coarse"), origins_of(ws))
    return state.select("origin", "id", "n", "setting", "level", "trend", F.col("cycle")[0].alias("next_cycle"), F.col("cycle")[6].alias("last_cycle"), "sse")


@query
def holt_winters_bands(ws):
    return closed_bands(ws.trainval("coarse"), origins_of(ws))


@query
def global_forecast(ws):
    """The global model at the end of train, for every series."""
    return forecast_global(ws.global_model(), ws.engineered(), ws.days()["train"])


@query
def global_quantiles(ws):
    """Seven quantiles of every series and day after the end of train, from the leaves of all trees."""
    levels = {"q05": 0.05, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95}
    return quantile_forecast(ws.global_model(), ws.engineered(), ws.days()["train"], levels)


@query
def score_later_origin(ws):
    """The same fitted model on two later blocks: the test days and the days after all data."""
    days, model = ws.days(), ws.global_model()
    return forecast_global(model, ws.engineered(), days["val"]).unionByName(
        forecast_global(model, ws.engineered(), days["test"])
    )


@query
def count_forecast(ws):
    """The negative binomial model at the end of train: quantiles over sampled paths of every series."""
    origin = ws.days()["train"]
    model = counts.fit_counts(ws.engineered(), origin, fit_ids=ws.fit_series())
    return counts.forecast_counts(model, ws.engineered(), origin)


#: Stated coefficients for the one-step mean, so that it can be checked without a fit.
STATED_COUNTS = counts.CountModel(
    {"log_lag_1": 0.125, "log_lag_7": 0.25, "log_lag_28": 0.125, "log_mean_7": 0.25, "log_mean_28": 0.25, "log_scale": 0.0625, "snap": 0.0625,
     **{f"wday_{d}": d / 64 for d in range(2, 8)}}, {"TX": 0.125, "WI": -0.25}, -0.5, 0.5)


@query
def count_one_step(ws):
    """The mean demand of every series and day by the days before it, under stated coefficients."""
    terms = counts.count_terms(features.engineer_features(ws.trainval("coarse")), ws.days()["train"])
    return counts.one_step_mean(STATED_COUNTS, terms).select("id", "d_num", "log_lag_28", "log_mean_7", "log_scale", "mean")


@query
def global_predict_rows(ws):
    """What the global model predicts from, at the end of train and at both later blocks."""
    days = ws.days()
    rows = [predict_rows(ws.engineered(), days[split]).withColumn("origin", F.lit(days[split])) for split in ("train", "val", "test")]
    return reduce(DataFrame.unionByName, rows).select(
        "origin", "id", "h", "target_day", "sell_price", "snap", "coldstart_flag", "rolling_mean_7", "rolling_std_28", "lag_7", "lag_28")


@query
def residual_bands(ws):
    """Residual quantiles of the seasonal naive by step of the horizon and volume segment."""
    judged = naive_scored(ws).join(segments(ws, "coarse").select("id", "volume_segment"), "id")
    residuals = judged.select((F.col("d_num") - F.col("origin")).cast("int").alias("h"), "volume_segment", (F.col("sales") - F.col("q50")).alias("residual"))
    return global_bands(residuals, "h", "volume_segment")


@query
def recent_mean(ws):
    """A forecaster made from a plain function: mean, least and largest of the last 28 days."""
    def fit(days, sales, origin, horizon):
        last = sales[-HORIZON:]
        return tuple(float(x) for x in (last.min(), last.mean(), last.max()))

    return forecasters.per_series_forecaster(fit, min_rows=HORIZON)(ws.trainval("coarse"), origins_of(ws))


def cold_setup(ws):
    """Cold-start holdout of the fine panel at the end of train."""
    origin = ws.days()["train"]
    cold = ws.cold("fine", 0.05)
    return cold, coldstart.coldstart_cutoff_day(origin), origin


@query
def coldstart_forecast(ws):
    return ws.cold_forecast()


# --- training data ------------------------------------------------------------------------------------


@query
def training_panel(ws):
    engineered = features.add_lag_features(features.engineer_features(ws.trainval("coarse")))
    return training_data.training_panel(engineered, ws.days()["train"]).select(
        "id", "d_num", "h", "target", "rolling_mean_28", "lag_7", "sell_price", "wday"
    )


def window_summary(windows):
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return windows.select(
        "id", "encoder_start", "decoder_start", "decoder_end",
        F.size("encoder").alias("encoder_len"), F.size("decoder").alias("decoder_len"),
        total("encoder").alias("encoder_sum"), total("decoder").alias("decoder_sum"),
        F.element_at("encoder", -1).alias("encoder_last"), F.element_at("decoder", 1).alias("decoder_first"),
    )


@query
def training_windows(ws):
    return window_summary(training_data.training_windows(ws.trainval("coarse")))


@query
def training_windows_predict(ws):
    return window_summary(training_data.training_windows(ws.trainval("coarse"), min_encoder=1, predict=True))


@query
def window_index(ws):
    return training_data.window_index(ws.trainval("coarse"))


@query
def window_values(ws):
    """Every window read through its pointer: sums and ends of the slices of target and covariates."""
    columns = ["sales", "sell_price", "wday"]
    panel = ws.trainval("coarse")
    out = training_data.window_values(training_data.window_index(panel), training_data.series_store(panel, columns), columns)
    total = lambda c: F.aggregate(c, F.lit(0).cast("double"), lambda a, x: a + x)
    return out.select(
        "id", "first_row", *[total(f"{side}_{c}").alias(f"{side}_{c}_sum") for c in columns for side in ("encoder", "decoder")],
        F.element_at("encoder_sales", -1).alias("encoder_last"), F.element_at("decoder_sales", 1).alias("decoder_first"))


def cold_panel(ws):
    cold, cutoff, origin = cold_setup(ws)
    return coldstart.truncate_coldstart_history(ws.trainval("fine"), cold, cutoff), cold, cutoff, origin


@query
def dropped_series(ws):
    """With 28 target lags and 30 encoder rows, no cold series has a window left before the origin."""
    panel, _, _, origin = cold_panel(ws)
    train = panel.where(F.col("d_num") <= origin)
    return training_data.dropped_series(train, training_data.training_windows(train, lag_rows=28))


@query
def series_scale(ws):
    return training_data.series_scale(ws.panel("fine"), ws.days()["train"])


@query
def leakage_audit(ws):
    panel, cold, cutoff, origin = cold_panel(ws)
    cold_rows = features.restrict_series(panel, cold)
    candidates = training_data.training_panel(features.engineer_features(panel), origin).withColumn("held_out", held_out_windows(origin))
    first_held = candidates.where("held_out").agg(F.min("target_day")).scalar()
    known = panel.where(F.col("d_num") > origin - HORIZON).select("store_id", "item_id", "wm_yr_wk", "sell_price").distinct()
    paid = demand.weekly_paid(ws.daily("fine").where(F.col("d_num") <= origin))
    later = demand.prices_from(paid, demand.week_of(F.lit(origin))).withColumnRenamed("sell_price", "price_by_origin")
    priced = known.where(F.col("wm_yr_wk") <= demand.week_of(F.lit(origin))).join(later, ["store_id", "item_id", "wm_yr_wk"], "left")
    windows = training_data.training_windows(cold_rows, min_encoder=1)
    naive = forecasters.seasonal_naive(panel, [origin])
    return training_data.leakage_audit({
        "cold_history_before_cutoff": (cold_rows, F.col("d_num") < cutoff),
        "cold_window_before_cutoff": (windows, F.col("encoder_start") < cutoff),
        "target_past_origin": (candidates, F.col("target_day") > origin),
        "training_target_inside_held_out": (candidates.where("not held_out"), F.col("target_day") >= first_held),
        "price_from_later_sales": (priced, ~F.col("sell_price").eqNullSafe(F.col("price_by_origin"))),
        "forecast_inside_history": (naive, F.col("d_num") <= F.col("origin")),
    })


# --- backtest reports ---------------------------------------------------------------------------------


@query
def score_forecast(ws):
    """One forecast on one window."""
    origin = ws.days()["train"]
    losses = backtest.backtest_losses(ws.trainval("coarse"), {"seasonal_naive": forecasters.seasonal_naive}, [origin])
    return losses.groupBy("model", "origin").agg(*metrics.score_columns())


@query
def backtest_results(ws):
    return backtest.run_backtest(ws.trainval("coarse"), SQL_MODELS, origins_of(ws), segments(ws, "coarse"), trusted=True)


@query
def backtest_all_models(ws):
    """All three per-series models on every fine series and origin."""
    return backtest.run_backtest(ws.trainval("fine"), backtest.FORECASTERS, origins_of(ws), segments(ws, "fine"), trusted=True)


@query
def backtest_summary(ws):
    return backtest.backtest_summary(
        backtest.run_backtest(ws.trainval("coarse"), SQL_MODELS, origins_of(ws), segments(ws, "coarse"), trusted=True)
    )


@query
def model_comparison(ws):
    """An earlier report read back from CSV and extended by a second model."""
    panel, origins, segs = ws.trainval("coarse"), origins_of(ws), segments(ws, "coarse")
    run = lambda name: backtest.run_backtest(panel, {name: SQL_MODELS[name]}, origins, segs, trusted=True)
    path = tables.write_csv(run("seasonal_naive"), scratch_path(ws.spark, "naive_report"), single_file=True)
    earlier = tables.read_report(ws.spark, path)
    empty = earlier.select("model", "n_series", "wql", "mase").where("false")
    newest = max(origins)
    return backtest.model_comparison(backtest.model_comparison(empty, earlier, newest), run("trend_weekly"), newest)


def cold_scores(ws):
    panel, cold, _, origin = cold_panel(ws)
    losses = backtest.backtest_losses(panel, {"seasonal_naive": forecasters.seasonal_naive}, [origin])
    return backtest.segmented_scores(losses, segments(ws, "fine"), cold)


@query
def segmented_scores(ws):
    return cold_scores(ws)


@query
def coldstart_comparison(ws):
    return backtest.coldstart_comparison(cold_scores(ws))


@query
def coldstart_scores(ws):
    """The cold-start retrained global model by start and volume segment."""
    panel, cold, _, origin = cold_panel(ws)
    forecast = ws.cold_forecast().withColumn("model", F.lit("global_coldstart"))
    losses = backtest.forecast_losses(panel, forecast, [origin])
    return backtest.segmented_scores(losses, segments(ws, "fine"), cold)


@query
def global_backtest(ws):
    """The global model refitted at every origin, scored like the per-series models."""
    panel, origins = ws.trainval("coarse"), origins_of(ws)
    forecast = backtest_global(ws.coarse_features(), origins).withColumn("model", F.lit("global"))
    losses = backtest.forecast_losses(panel, forecast, origins)
    return backtest.results_by_segment(losses, segments(ws, "coarse"))


# --- decisions ----------------------------------------------------------------------------------------


def policy_rows(ws):
    forecast = forecasters.seasonal_naive(ws.trainval("coarse"), [ws.days()["val"]])
    return policy.policy_input(ws.panel("coarse"), forecast)


@query
def policy_input(ws):
    return policy_rows(ws)


@query
def inventory_trace(ws):
    return policy.inventory_trace(policy_rows(ws))


def per_series(ws):
    return policy.policy_per_series(policy.inventory_trace(policy_rows(ws)))


@query
def policy_per_series(ws):
    return per_series(ws)


@query
def policy_summary(ws):
    return policy.policy_summary(per_series(ws))


@query
def policy_headline(ws):
    return policy.policy_headline(policy.policy_summary(per_series(ws)))


def global_test_forecast(ws):
    return forecast_global(ws.global_model(), ws.engineered(), ws.days()["val"])


@query
def global_policy_summary(ws):
    """The policies on the global model's forecast of the test days."""
    trace = policy.inventory_trace(policy.policy_input(ws.panel("fine"), global_test_forecast(ws)))
    return policy.policy_summary(policy.policy_per_series(trace))


# --- reshaping and reports ----------------------------------------------------------------------------


@query
def future_rows(ws):
    end = ws.days()["test"]
    return reshape.future_rows(
        ws.panel("fine"), ws.calendar(), ws.prices("fine"), end + 1, end + HORIZON
    ).select("id", "d_num", "date", "wm_yr_wk", "weekday", "event_name_1", "sell_price", "sales")


@query
def explode_forecast(ws):
    naive = forecasters.seasonal_naive(ws.trainval("coarse"), origins_of(ws))
    return reshape.explode_forecast(reshape.pack_forecast(naive))


def block_origins(ws):
    return ws.days()["val"], ws.days()["test"]


def primary_trend(ws, origins):
    """The trend model on every series it can forecast; at the first origin the cold series have too little history."""
    visible = coldstart.truncate_coldstart_history(
        ws.panel("coarse"), ws.cold("coarse", 0.2), coldstart.coldstart_cutoff_day(origins[0], visible_days=10))
    return forecasters.trend_weekly(visible, origins)


@query
def blend_forecasts(ws):
    origins = list(block_origins(ws))
    return reshape.blend_forecasts(
        primary_trend(ws, origins), forecasters.seasonal_naive(ws.panel("coarse"), origins)
    )


def _some_suffixed(forecast):
    """Every other series as raw files name them, with the block at the end of the id."""
    return forecast.withColumn("id", F.when(F.length("id") % 2 == 0, F.concat("id", F.lit("_evaluation"))).otherwise(F.col("id")))


@query
def forecast_wide(ws):
    origin = ws.days()["val"]
    naive = forecasters.seasonal_naive(ws.trainval("coarse"), [origin])
    return reshape.forecast_wide(_some_suffixed(naive), {origin: "validation"})


@query
def submission_table(ws):
    origins = block_origins(ws)
    naive = forecasters.seasonal_naive(ws.panel("coarse"), list(origins))
    return reports.submission_table(primary_trend(ws, list(origins)), naive, origins)


@query
def global_submission(ws):
    """Both blocks from the fitted global model, with the seasonal naive for series it does not cover."""
    origins = block_origins(ws)
    covered = global_test_forecast(ws).unionByName(forecast_global(ws.global_model(), ws.engineered(), origins[1]))
    return reports.submission_table(covered, forecasters.seasonal_naive(ws.panel("fine"), list(origins)), origins)


def full_report(ws, grain, frac):
    origin = ws.days()["val"]
    cold = ws.cold(grain, frac)
    naive = forecasters.seasonal_naive(ws.trainval(grain), [origin])
    return reports.series_report(ws.panel(grain), naive, segments(ws, grain), cold, origin)


@query
def series_report(ws):
    return full_report(ws, "coarse", 0.2)


@query
def series_picker(ws):
    return reports.series_picker(full_report(ws, "fine", 0.05), cold_only=True)
