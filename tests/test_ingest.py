import datetime

import pytest

from tallycast.operators import ingest
from tallycast.session import scratch_path
from tallycast.sources import tables

DAYS = "d string, date date, weekday string, wm_yr_wk int, wday int, month int, year int, event_name_1 string, \
event_type_1 string, event_name_2 string, event_type_2 string, snap_CA int, snap_TX int, snap_WI int"


@pytest.fixture
def raw(spark):
    ids = "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string"
    wide = spark.createDataFrame(
        [("A", "a", "x", "c", "s", "CA", 0, 1, 2), ("B", "b", "x", "c", "s", "CA", 5, 6, 7)],
        f"{ids}, d_1 int, d_2 int, d_3 int",
    )
    date = lambda n: datetime.date(2011, 1, 28 + n)
    calendar = spark.createDataFrame(
        [
            ("d_1", date(1), "Saturday", 11101, 1, 1, 2011, None, None, None, None, 0, 0, 0),
            ("d_2", date(2), "Sunday", 11101, 2, 1, 2011, "SuperBowl", "Sporting", None, None, 1, 0, 0),
            ("d_3", date(3), "Monday", 11102, 3, 1, 2011, None, None, None, None, 0, 0, 0),
        ],
        DAYS,
    )
    prices = spark.createDataFrame(
        [("s", "a", 11101, 9.99), ("s", "a", 11102, 9.99), ("s", "b", 11102, 4.50)], tables.PRICE_SCHEMA
    )
    return wide, calendar, prices


def joined(raw):
    wide, calendar, prices = raw
    return ingest.join_prices(ingest.join_calendar(ingest.melt_sales(wide), calendar), prices)


def test_melt(raw):
    rows = ingest.melt_sales(raw[0]).collect()
    assert len(rows) == 6
    assert {(r.id, r.d, r.d_num): r.sales for r in rows}[("A", "d_2", 2)] == 1


def test_calendar_fills_missing_events(raw):
    rows = {r.d: r for r in joined(raw).where("id = 'A'").collect()}
    assert rows["d_2"].event_name_1 == "SuperBowl"
    assert rows["d_1"].event_name_1 == rows["d_2"].event_name_2 == "none"


def test_price_is_null_before_release(raw):
    rows = {r.d_num: r.sell_price for r in joined(raw).where("id = 'B'").collect()}
    assert rows == {1: None, 2: None, 3: 4.50}


def test_pre_release_rows_and_stats(raw):
    panel = joined(raw)
    assert ingest.drop_pre_release(panel).count() == 4
    assert tuple(ingest.pre_release_stats(panel).first()) == (6, 4, 2, 33.33)
    assert tuple(ingest.pre_release_stats(panel.where("false")).first()) == (0, 0, 0, 0.0)


def test_split_boundaries(spark):
    panel = spark.range(1, 101).selectExpr("'A' as id", "cast(id as int) as d_num")
    profile = {r.split: (r.rows, r.min_day, r.max_day, r.n_series) for r in
               tables.split_profile(ingest.assign_split(panel)).collect()}
    assert profile == {"train": (44, 1, 44, 1), "val": (28, 45, 72, 1), "test": (28, 73, 100, 1)}


def test_csv_tables_survive_the_whole_ingest(spark, raw):
    wide, calendar, prices = raw
    root = scratch_path(spark, "test-raw")
    scanned = ingest.build_panel(
        ingest.melt_sales(tables.scan_sales_wide(spark, tables.write_csv(wide, f"{root}/sales"))),
        tables.scan_calendar(spark, tables.write_csv(calendar, f"{root}/calendar")),
        tables.scan_prices(spark, tables.write_csv(prices, f"{root}/prices")),
    )
    direct = ingest.build_panel(ingest.melt_sales(wide), calendar, prices).select(*scanned.columns)
    assert scanned.exceptAll(direct).count() == 0 and scanned.count() == 4


def test_missing_report_is_an_explicit_error(spark):
    with pytest.raises(FileNotFoundError, match="run the step"):
        tables.read_report(spark, "/tmp/there-is-no-such-report")


def test_split_filter_prunes_partitions_and_columns(spark, raw):
    path = tables.write_splits(ingest.build_panel(ingest.melt_sales(raw[0]), *raw[1:]), scratch_path(spark, "splits"))
    kept = tables.load_panel(spark.read.parquet(path), ("test",), ["id", "d_num"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "sell_price" not in plan
