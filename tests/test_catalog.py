"""Every query against its SQL on the smallest tables."""

import threading

import duckdb
import pytest

import __spark_entry__ as entry
import check

SQL_KEYS = sorted(entry.oracle_sql())
ROWS_ONLY = {"holt_winters": 4200, "backtest_all_models": 45}


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for table in check.TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def test_every_sql_belongs_to_a_query():
    assert set(SQL_KEYS) <= set(entry.queries())


@pytest.mark.parametrize("name", SQL_KEYS)
def test_query_matches_sql(spark, con, sf_dir, name):
    assert check.compare(spark, con, name, sf_dir)[0] == "ok"


@pytest.mark.parametrize("name", SQL_KEYS)
def test_every_form_of_the_sql_ends(con, name):
    """Bare, counted and limited forms are planned differently; none may run away."""
    for form in ("{0}", "SELECT count(*) FROM ({0})", "SELECT * FROM ({0}) LIMIT 100001"):
        timer = threading.Timer(10, con.interrupt)
        timer.start()
        try:
            con.execute(form.format(entry.oracle_sql()[name])).fetchall()
        finally:
            timer.cancel()


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_row_counts(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() == ROWS_ONLY[name]


FITTED = {"global_forecast": 1, "score_later_origin": 2, "coldstart_forecast": 1, "count_forecast": 1, "global_quantiles": 1}


@pytest.mark.parametrize("name", FITTED)
def test_fitted_models_forecast_every_series(spark, sf_dir, name):
    """28 ordered days per series and origin, for all series of the fine panel, the same after repartitioning."""
    from tallycast.catalog.workspace import Workspace

    out = entry.queries()[name](spark, sf_dir)
    origins = Workspace(spark, sf_dir).days()
    series = entry.queries()["series_dim"](spark, sf_dir).count()
    rows = out.collect()
    assert len(rows) == 28 * series * FITTED[name]
    assert all(0 <= r.q10 <= r.q50 <= r.q90 and 1 <= r.d_num - r.origin <= 28 for r in rows)
    assert {r.origin for r in rows} <= set(origins.values())
    again = out.repartition(3, "d_num").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


@pytest.mark.parametrize("name,n", [("coldstart_scores", 5), ("global_backtest", 15), ("global_policy_summary", 2)])
def test_fitted_model_reports(spark, sf_dir, name, n):
    assert entry.queries()[name](spark, sf_dir).count() == n


def test_global_submission_has_two_rows_per_series(spark, sf_dir):
    rows = entry.queries()["global_submission"](spark, sf_dir).collect()
    series = entry.queries()["series_dim"](spark, sf_dir).count()
    assert len(rows) == 2 * series and len({r.id for r in rows}) == 2 * series
