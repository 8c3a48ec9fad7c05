"""The retail panel derived from the order tables: daily demand, calendar, prices and the wide sales table.

Two grains share one layout. The fine one has a series per item group and nation, the coarse one per
part type and region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from tallycast.functions.names import HORIZON, ID_COLUMNS

# First day of the day index, state of each region, yearly events, days with support payments.
EPOCH = "1995-01-01"
STATE_OF_REGION = {"AMERICA": "CA", "ASIA": "TX", "EUROPE": "WI"}
EVENTS_1 = {"12-25": ("Christmas", "National"), "07-04": ("July4", "National")}
EVENTS_2 = {"02-29": ("LeapDay", "Other")}
SNAP_DAYS = {"snap_CA": (1, 3), "snap_TX": (4, 6), "snap_WI": (7, 9)}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Columns that identify a series and the region it belongs to.
_SERIES = ["item_id", "cat_id", "store_id", "r_name"]


def _as_daily(sums: DataFrame) -> DataFrame:
    """Attach state and series id to sums per series and day."""
    state = F.col("r_name")
    for region, code in STATE_OF_REGION.items():
        state = F.when(F.col("r_name") == region, F.lit(code)).otherwise(state)
    return sums.select(
        F.concat_ws("|", "item_id", "store_id").alias("id"), "item_id", F.col("item_id").alias("dept_id"), "cat_id",
        "store_id", state.alias("state_id"), "d_num", "sales", "cents", "r_name",
    )


def daily_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and cents sold per item group, nation and day, only for days with a sale.

    Lines meet both dimensions first: by broadcast where a dimension is under the broadcast threshold, else by
    joins that adaptive execution splits at a hot part or supplier. One aggregation follows, whose sums per
    series and day are combined before its shuffle; lines of a part and supplier on one day are too few to sum earlier.
    """
    day = F.datediff(F.col("l_shipdate"), F.lit(EPOCH)).alias("d_num")
    units = F.col("l_quantity").cast("long")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", day, units.alias("sales"), cents.alias("cents"))
    item = F.concat_ws("_", "p_type", F.ceil(F.col("p_size") / 25).cast("string"))
    parts = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), item.alias("item_id"), F.col("p_type").alias("cat_id")
    )
    places = (
        _table(spark, sf_dir, "supplier")
        .join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("store_id"), "r_name")
    )
    sums = [F.sum("sales").alias("sales"), F.sum("cents").alias("cents")]
    return _as_daily(lines.join(parts, "l_partkey").join(places, "l_suppkey").groupBy(*_SERIES, "d_num").agg(*sums))


def coarse_demand(daily: DataFrame) -> DataFrame:
    """The same demand per part type and region, summed from the finer one and not from the lines."""
    regrouped = daily.select(
        F.col("cat_id").alias("item_id"), "cat_id", F.col("r_name").alias("store_id"), "r_name", "d_num", "sales", "cents"
    )
    sums = [F.sum("sales").alias("sales"), F.sum("cents").alias("cents")]
    return _as_daily(regrouped.groupBy(*_SERIES, "d_num").agg(*sums))


def demand_panel(daily: DataFrame) -> DataFrame:
    """Every series on every day from 1 to the last day of the data, zero where nothing was sold."""
    last_day = daily.agg(F.max("d_num")).scalar()
    grid = (
        daily.select(*ID_COLUMNS)
        .distinct()
        .withColumn("last_day", last_day)
        .select(*ID_COLUMNS, F.explode(F.sequence(F.lit(1), F.col("last_day"))).alias("d_num"))
    )
    return grid.join(daily.select("id", "d_num", "sales"), ["id", "d_num"], "left").select(
        *ID_COLUMNS,
        F.concat(F.lit("d_"), F.col("d_num").cast("string")).alias("d"),
        F.coalesce("sales", F.lit(0)).cast("int").alias("sales"),
        "d_num",
    )


def week_of(day: Column) -> Column:
    return F.floor((day - 1) / 7).cast("int") + 1


def calendar_dim(daily: DataFrame, ahead: int = HORIZON) -> DataFrame:
    """One row per day, up to ``ahead`` days past the data, with events and support-payment flags."""
    last_day = daily.agg(F.max("d_num").alias("last_day"))
    days = last_day.select(F.explode(F.sequence(F.lit(1), F.col("last_day") + ahead)).alias("d_num"))
    date = F.date_add(F.lit(EPOCH).cast("date"), F.col("d_num"))
    month_day = F.date_format("date", "MM-dd")
    slot = F.dayofmonth("date") % 10

    def event(table: dict, part: int) -> Column:
        out = F.lit(None).cast("string")
        for when, names in table.items():
            out = F.when(month_day == when, F.lit(names[part])).otherwise(out)
        return out

    return days.withColumn("date", date).select(
        F.concat(F.lit("d_"), F.col("d_num").cast("string")).alias("d"),
        "date",
        week_of(F.col("d_num")).alias("wm_yr_wk"),
        F.date_format("date", "EEEE").alias("weekday"),
        (F.dayofweek("date") % 7 + 1).alias("wday"),
        F.month("date").alias("month"),
        F.year("date").alias("year"),
        event(EVENTS_1, 0).alias("event_name_1"),
        event(EVENTS_1, 1).alias("event_type_1"),
        event(EVENTS_2, 0).alias("event_name_2"),
        event(EVENTS_2, 1).alias("event_type_2"),
        *[slot.between(*span).cast("int").alias(flag) for flag, span in SNAP_DAYS.items()],
    )


def sell_prices(daily: DataFrame, ahead: int = HORIZON) -> DataFrame:
    """Weekly price per store and item: what was paid on average in the latest earlier week with a sale.

    A week's own sales never enter its price, so prices up to a week past any day are known on that day. The
    first price stands in the week after the first sale.
    """
    last_day = daily.agg(F.max("d_num")).scalar()
    return prices_from(weekly_paid(daily), week_of(last_day + ahead))


def weekly_paid(daily: DataFrame) -> DataFrame:
    """What a unit cost on average in every week with a sale."""
    sums = daily.groupBy("store_id", "item_id", week_of(F.col("d_num")).alias("wm_yr_wk")).agg(
        F.sum("cents").alias("cents"), F.sum("sales").alias("units"))
    return sums.select("store_id", "item_id", "wm_yr_wk", F.expr("cents div units / 100.0D").alias("paid"))


def prices_from(weekly: DataFrame, last_week: Column) -> DataFrame:
    """Prices of every week after the first paid one, up to ``last_week``."""
    by_item = W.partitionBy("store_id", "item_id").orderBy("wm_yr_wk")
    # Each observed week prices the weeks after it, up to and with the next observed one, so no week grid has to be joined.
    spans = weekly.withColumn("next_week", F.lead("wm_yr_wk").over(by_item)).withColumn("last_week", last_week)
    until = F.coalesce("next_week", "last_week")
    return spans.where(F.col("wm_yr_wk") < until).select(
        "store_id",
        "item_id",
        F.explode(F.sequence(F.col("wm_yr_wk") + 1, until)).alias("wm_yr_wk"),
        F.col("paid").alias("sell_price"),
    )


def sales_wide(panel: DataFrame, last_day: int) -> DataFrame:
    """One row per series and one column per day, read out of one array per series; ``panel`` has every day of it."""
    days = panel.groupBy(*ID_COLUMNS).agg(F.sort_array(F.collect_list(F.struct("d_num", "sales"))).alias("days"))
    # The generator keeps the array from being built again for every column.
    packed = days.select(*ID_COLUMNS, F.explode(F.array(F.col("days.sales"))).alias("line"))
    return packed.select(*ID_COLUMNS, *[F.col("line")[n - 1].alias(f"d_{n}") for n in range(1, last_day + 1)])
