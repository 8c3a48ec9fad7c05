"""Training data for the global model: horizon panel, encoder/decoder windows, scales, codes, leakage audit."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, Window as W, functions as F

from tallycast.functions.names import HORIZON
from tallycast.operators.features import by_day


def horizon_rows(
    engineered: DataFrame, horizon: int = HORIZON, ahead_columns: tuple[str, ...] = (), keep_unknown: bool = False,
    where=None,
) -> DataFrame:
    """Every row paired with each of its next ``horizon`` rows: step ``h``, their sales as ``target``.

    ``ahead_columns`` of the target row (known in advance, such as weekday or price) come along with the
    prefix ``t_``. ``where`` picks the base rows before they are multiplied by the horizon.
    """
    ahead = F.struct(
        F.col("sales").alias("target"), F.col("d_num").alias("target_day"),
        *[F.col(c).alias(f"t_{c}") for c in ahead_columns],
    )
    rows = engineered.withColumn("ahead", F.collect_list(ahead).over(by_day().rowsBetween(1, horizon)))
    if where is not None:
        rows = rows.where(where)
    out = rows.select(*engineered.columns, F.posexplode("ahead").alias("pos", "step")).select(
        *engineered.columns, (F.col("pos") + 1).alias("h"), "step.*"
    )
    return out if keep_unknown else out.where(F.col("target").isNotNull())


def training_panel(
    engineered: DataFrame, origin_day: int, horizon: int = HORIZON, stride: int = 7, lookback_days: int = 180,
    ahead_columns: tuple[str, ...] = (),
) -> DataFrame:
    """One row per series, candidate origin and step. Candidates are ``stride`` days apart within the
    lookback, and each has its whole horizon before ``origin_day``.
    """
    history = engineered.where(F.col("d_num") <= origin_day)
    first_day = history.agg(F.min("d_num")).scalar()
    latest = origin_day - horizon
    # Rows before the lookback are no candidates and no targets of one.
    recent = history.where(F.col("d_num") >= min(origin_day - lookback_days, latest)).withColumn(
        "earliest", F.greatest(first_day, F.lit(origin_day - lookback_days))
    )
    regular = F.col("d_num").between(F.col("earliest"), F.lit(latest)) & (
        (F.col("d_num") - F.col("earliest")) % stride == 0
    )
    only_latest = (F.col("earliest") > latest) & (F.col("d_num") == latest)
    return horizon_rows(recent, horizon, ahead_columns, where=regular | only_latest).drop("earliest")


def origin_panels(
    engineered: DataFrame, origins: list[int], horizon: int = HORIZON, stride: int = 7, lookback_days: int = 180,
    ahead_columns: tuple[str, ...] = (),
) -> DataFrame:
    """The union of :func:`training_panel` at every origin, tagged with ``origin``, from one pass over the history.

    The rows ahead of a candidate do not depend on the origin; those past an origin are dropped for it.
    """
    history = engineered.where(F.col("d_num") <= max(origins))
    first_day = history.agg(F.coalesce(F.min("d_num"), F.lit(0))).first()[0]

    def candidate(o: int):
        earliest, latest = max(first_day, o - lookback_days), o - horizon
        if earliest > latest:
            return F.col("d_num") == latest
        return F.col("d_num").between(earliest, latest) & ((F.col("d_num") - earliest) % stride == 0)

    recent = history.where(F.col("d_num") >= min(min(o - lookback_days, o - horizon) for o in origins))
    serves = F.filter(F.array(*[F.when(candidate(o), F.lit(o)) for o in origins]), lambda o: o.isNotNull())
    tagged = recent.withColumn("serves", serves)
    rows = horizon_rows(tagged, horizon, ahead_columns, where=F.size("serves") > 0)
    return rows.withColumn("origin", F.explode("serves")).drop("serves").where(F.col("target_day") <= F.col("origin"))


def training_windows(
    panel: DataFrame, max_encoder: int = 60, min_encoder: int = 30, max_decoder: int = HORIZON,
    predict: bool = False, lag_rows: int = 0,
) -> DataFrame:
    """Encoder and decoder arrays around every first decoder day of every series.

    ``predict`` keeps only the last window with a full decoder per series. ``lag_rows`` rows at the start
    of a series are unusable when the model takes target lags of that length.
    """
    n_row = F.row_number().over(by_day())
    usable = panel.select("id", "d_num", "sales", n_row.alias("n_row")).where(F.col("n_row") > lag_rows)
    before, from_here = by_day().rowsBetween(-max_encoder, -1), by_day().rowsBetween(0, max_decoder - 1)
    windows = usable.select(
        "id",
        F.min("d_num").over(before).alias("encoder_start"),
        F.col("d_num").alias("decoder_start"),
        F.collect_list("sales").over(before).alias("encoder"),
        F.collect_list("sales").over(from_here).alias("decoder"),
        F.max("d_num").over(W.partitionBy("id")).alias("last_day"),
        F.max("d_num").over(from_here).alias("decoder_end"),
    ).where(F.size("encoder") >= min_encoder)
    if predict:
        full = (F.size("decoder") == max_decoder) & (F.col("decoder_end") == F.col("last_day"))
        windows = windows.where(full)
    return windows.drop("last_day")


def series_store(panel: DataFrame, columns: list[str]) -> DataFrame:
    """One row per series: its days in order and an array of every column, as long as the days."""
    row = F.struct("d_num", *columns)
    ordered = panel.groupBy("id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return ordered.select("id", *[F.col(f"rows.{c}").alias(c) for c in ("d_num", *columns)])


def window_index(
    panel: DataFrame, max_encoder: int = 60, min_encoder: int = 30, max_decoder: int = HORIZON, stride: int = 1, lag_rows: int = 0,
) -> DataFrame:
    """``[id, first_row, encoder_len, decoder_len]``: the windows of :func:`training_windows` as places in the arrays of a series, from 1.

    Only the number of rows of a series is needed; no value is copied. ``stride`` keeps every so many first decoder rows.
    """
    rows = panel.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    first = lag_rows + min_encoder + 1
    starts = rows.where(F.col("n") >= first).select("id", "n", F.explode(F.sequence(F.lit(first), F.col("n"), F.lit(stride))).alias("decoder_row"))
    encoder = F.least(F.lit(max_encoder), F.col("decoder_row") - 1 - lag_rows)
    return starts.select(
        "id", (F.col("decoder_row") - encoder).alias("first_row"), encoder.alias("encoder_len"),
        F.least(F.lit(max_decoder), F.col("n") - F.col("decoder_row") + 1).alias("decoder_len"))


def window_values(index: DataFrame, store: DataFrame, columns: list[str]) -> DataFrame:
    """``index`` with the encoder and decoder slice of every column, cut at read time. Only the index and one row per series are shuffled."""
    encoder = lambda c: F.slice(c, F.col("first_row"), F.col("encoder_len")).alias(f"encoder_{c}")
    decoder = lambda c: F.slice(c, F.col("first_row") + F.col("encoder_len"), F.col("decoder_len")).alias(f"decoder_{c}")
    joined = index.join(store, "id")
    return joined.select(*index.columns, *[part(c) for c in columns for part in (encoder, decoder)])


def dropped_series(panel: DataFrame, windows: DataFrame) -> DataFrame:
    """Series without a single window, with their number of rows, so that none disappears unnoticed."""
    rows = panel.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(windows.select("id").distinct(), "id", "left_anti")


def series_scale(panel: DataFrame, last_train_day: int, floor: float = 1e-6) -> DataFrame:
    """Target scale per series: mean sales over the training rows, never below ``floor``."""
    train = panel.where(F.col("d_num") <= last_train_day)
    return train.groupBy("id").agg(F.greatest(F.avg("sales"), F.lit(floor)).alias("scale"))


def fit_codes(train: DataFrame, columns: list[str]) -> PipelineModel:
    """Alphabetical codes per column, fitted on training rows. For columns of bounded variety, such as the
    levels of the hierarchy and the calendar; ids stay strings.
    """
    return Pipeline(
        stages=[
            StringIndexer(
                inputCols=columns, outputCols=[f"{c}_code" for c in columns],
                stringOrderType="alphabetAsc", handleInvalid="keep",
            )
        ]
    ).fit(train)


def encode_categoricals(df: DataFrame, codes: PipelineModel) -> DataFrame:
    """Add the integer codes; a value unseen in training gets the next free code of its column."""
    coded = codes.transform(df)
    return coded.withColumns({c: F.col(c).cast("int") for c in coded.columns if c not in df.columns})


def leakage_audit(checks: dict[str, tuple[DataFrame, object]]) -> DataFrame:
    """Rows checked and rows that break the rule, per rule. Each rule is a frame and its violation predicate."""
    parts = [
        frame.agg(
            F.count(F.lit(1)).alias("rows_checked"),
            F.coalesce(F.sum(F.when(broken, 1).otherwise(0)), F.lit(0)).cast("long").alias("violations"),
        ).select(F.lit(rule).alias("rule"), "rows_checked", "violations")
        for rule, (frame, broken) in checks.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
