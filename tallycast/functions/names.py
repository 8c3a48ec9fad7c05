"""Column names and levels that sources, features, forecasts and reports share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Quantile levels, the names used inside the library and those of written forecasts.
QUANTILES = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
PUBLISHED = {"q10": "q0.1", "q50": "q0.5", "q90": "q0.9"}

# Column groups of the panel.
ID_COLUMNS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
EVENT_COLUMNS = ["event_name_1", "event_type_1", "event_name_2", "event_type_2"]
SNAP_COLUMNS = ["snap_CA", "snap_TX", "snap_WI"]
CALENDAR_COLUMNS = ["d", "date", "wm_yr_wk", "weekday", "wday", "month", "year", *EVENT_COLUMNS, *SNAP_COLUMNS]

# Covariate groups of the global model.
STATIC_CATEGORICALS = ["cat_id", "dept_id", "store_id", "state_id"]
CALENDAR_REALS = ["wday", "month", "year", "snap"]
CALENDAR_CATEGORICALS = ["weekday", *EVENT_COLUMNS]
PRICE_REALS = ["sell_price", "price_change_flag"]
ROLLING_WINDOWS = (7, 28)
TARGET_LAGS = (7, 28)

# Horizons and policy constants.
HORIZON = 28
SEASON = 7
COLDSTART_VISIBLE_DAYS = 27
REVIEW_PERIOD = 7
HOLDING_RATE = 0.20  # of the unit price, per year
HIGH_VOLUME_LEVEL = 0.8


def rolling_feature_names(windows=ROLLING_WINDOWS) -> list[str]:
    return [f"rolling_{stat}_{w}" for w in windows for stat in ("mean", "std")]


def publish(forecast: DataFrame) -> DataFrame:
    """Rename the quantiles to their written form. Dots need backticks, so this belongs at the sink."""
    return forecast.withColumnsRenamed(PUBLISHED)


def unpublish(forecast: DataFrame) -> DataFrame:
    """Read a written forecast back into the library's names and types."""
    return forecast.select(
        *[F.col(f"`{c}`") for c in forecast.columns if c not in (*PUBLISHED.values(), "id", "d_num")],
        F.col("id").cast("string").alias("id"),
        F.col("d_num").cast("long").alias("d_num"),
        *[F.col(f"`{written}`").cast("double").alias(q) for q, written in PUBLISHED.items()],
    )
