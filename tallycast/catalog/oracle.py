"""The SQL each query is checked against, over the same tables. Written row by row in plain joins and
windows, so it shares no shortcut with the Spark side (no array plans, no per-stretch sums, no closed form).
"""

from __future__ import annotations

import re

from tallycast.functions.names import CALENDAR_CATEGORICALS, STATIC_CATEGORICALS

ORACLES: dict[str, str] = {}


def r(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def rounded(*names: str) -> str:
    return ", ".join(f"{r(n)} AS {n}" for n in names)


# --- the panel ----------------------------------------------------------------------------------------


def base(grain: str) -> str:
    if grain == "fine":
        item, store = "p_type || '_' || CAST(CAST(ceil(p_size / 25.0) AS BIGINT) AS VARCHAR)", "n_name"
    else:
        item, store = "p_type", "r_name"
    return f"""
daily AS MATERIALIZED (
  SELECT item_id || '|' || store_id AS id, item_id, item_id AS dept_id, cat_id, store_id, state_id, d_num,
         CAST(sum(units) AS BIGINT) AS sales, CAST(sum(cents) AS BIGINT) AS cents
  FROM (
    SELECT {item} AS item_id, p_type AS cat_id, {store} AS store_id,
           CASE r_name WHEN 'AMERICA' THEN 'CA' WHEN 'ASIA' THEN 'TX' WHEN 'EUROPE' THEN 'WI' ELSE r_name END AS state_id,
           CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS d_num,
           CAST(l_quantity AS BIGINT) AS units, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  GROUP BY ALL),
bounds AS (SELECT CAST(max(d_num) AS INTEGER) AS m, m - 28 AS val_end, m - 56 AS train_end, m - 82 AS cutoff FROM daily),
dims AS (SELECT DISTINCT id, item_id, dept_id, cat_id, store_id, state_id FROM daily),
all_days AS (SELECT CAST(unnest(generate_series(1, m + 28)) AS INTEGER) AS d_num FROM bounds),
calendar AS (
  SELECT 'd_' || d_num AS d, date, CAST((d_num - 1) // 7 + 1 AS INTEGER) AS wm_yr_wk,
         strftime(date, '%A') AS weekday, CAST((dayofweek(date) + 1) % 7 + 1 AS INTEGER) AS wday,
         CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year,
         CASE strftime(date, '%m-%d') WHEN '12-25' THEN 'Christmas' WHEN '07-04' THEN 'July4' END AS event_name_1,
         CASE strftime(date, '%m-%d') WHEN '12-25' THEN 'National' WHEN '07-04' THEN 'National' END AS event_type_1,
         CASE strftime(date, '%m-%d') WHEN '02-29' THEN 'LeapDay' END AS event_name_2,
         CASE strftime(date, '%m-%d') WHEN '02-29' THEN 'Other' END AS event_type_2,
         CAST(day(date) % 10 BETWEEN 1 AND 3 AS INTEGER) AS "snap_CA",
         CAST(day(date) % 10 BETWEEN 4 AND 6 AS INTEGER) AS "snap_TX",
         CAST(day(date) % 10 BETWEEN 7 AND 9 AS INTEGER) AS "snap_WI"
  FROM (SELECT d_num, CAST(DATE '1995-01-01' + d_num AS DATE) AS date FROM all_days)),
weekly AS (
  SELECT store_id, item_id, CAST((d_num - 1) // 7 + 1 AS INTEGER) AS wm_yr_wk,
         CAST(sum(cents) AS BIGINT) // CAST(sum(sales) AS BIGINT) / 100.0 AS paid
  FROM daily GROUP BY ALL),
prices AS (
  SELECT store_id, item_id, wm_yr_wk,
         CAST(last_value(paid IGNORE NULLS) OVER (PARTITION BY store_id, item_id ORDER BY wm_yr_wk
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS sell_price
  FROM (SELECT store_id, item_id, CAST(unnest(generate_series(first_week, (SELECT (m + 27) // 7 + 1 FROM bounds))) AS INTEGER) AS wm_yr_wk
        FROM (SELECT store_id, item_id, min(wm_yr_wk) AS first_week FROM weekly GROUP BY ALL))
  LEFT JOIN weekly USING (store_id, item_id, wm_yr_wk)
  QUALIFY sell_price IS NOT NULL),
long AS (
  SELECT dims.*, 'd_' || all_days.d_num AS d, all_days.d_num, CAST(coalesce(daily.sales, 0) AS INTEGER) AS sales
  FROM dims CROSS JOIN all_days LEFT JOIN daily ON daily.id = dims.id AND daily.d_num = all_days.d_num
  WHERE all_days.d_num <= (SELECT m FROM bounds)),
joined AS (
  SELECT long.*, date, c.wm_yr_wk, weekday, wday, month, year,
         coalesce(event_name_1, 'none') AS event_name_1, coalesce(event_type_1, 'none') AS event_type_1,
         coalesce(event_name_2, 'none') AS event_name_2, coalesce(event_type_2, 'none') AS event_type_2,
         "snap_CA", "snap_TX", "snap_WI", sell_price
  FROM long LEFT JOIN calendar c ON long.d = c.d
  LEFT JOIN prices p ON long.store_id = p.store_id AND long.item_id = p.item_id AND c.wm_yr_wk = p.wm_yr_wk),
panel AS MATERIALIZED (
  SELECT *, CASE WHEN d_num > (SELECT val_end FROM bounds) THEN 'test'
                 WHEN d_num > (SELECT train_end FROM bounds) THEN 'val' ELSE 'train' END AS split
  FROM joined WHERE sell_price IS NOT NULL),
trainval AS MATERIALIZED (SELECT * FROM panel WHERE split <> 'test')"""


def sql(name: str, grain: str, ctes: list[str], select: str) -> None:
    ORACLES[name] = "WITH " + ",\n".join([base(grain), *ctes]) + "\n" + select


# --- shared pieces ------------------------------------------------------------------------------------

ORIGINS = "origins AS (SELECT CAST(unnest(generate_series(train_end - 112, train_end, 28)) AS INTEGER) AS origin FROM bounds)"
LAST_ORIGIN = "origins AS (SELECT train_end AS origin FROM bounds)"
VAL_ORIGIN = "origins AS (SELECT val_end AS origin FROM bounds)"
BLOCK_ORIGINS = "origins AS (SELECT val_end AS origin FROM bounds UNION ALL SELECT m FROM bounds)"


def nearest(values: str, level: float) -> str:
    return f"list_extract({values}, CAST(floor((len({values}) - 1) * {level} + 0.5) AS INTEGER) + 1)"


def history(rows: str) -> str:
    return f"""
history AS MATERIALIZED (
  SELECT origin, id, d_num, sales, count(*) OVER (PARTITION BY origin, id) AS n,
         row_number() OVER (PARTITION BY origin, id ORDER BY d_num DESC) AS back,
         sales - lag(sales, 7) OVER (PARTITION BY origin, id ORDER BY d_num) AS resid
  FROM {rows} JOIN origins ON d_num <= origin)"""


def repaired(q10: str, q50: str, q90: str) -> str:
    p10, p50, p90 = (f"greatest(CAST({q} AS DOUBLE), 0.0)" for q in (q10, q50, q90))
    return f"least({p10}, {p50}) AS q10, {p50} AS q50, greatest({p90}, {p50}) AS q90"


NAIVE = f"""
bands AS (
  SELECT origin, id, coalesce({nearest('l', 0.1)}, 0) AS low, coalesce({nearest('l', 0.9)}, 0) AS high
  FROM (SELECT origin, id, list_sort(list(resid) FILTER (WHERE resid IS NOT NULL)) AS l FROM history GROUP BY origin, id)),
naive AS MATERIALIZED (
  SELECT h.origin, h.id, CAST(h.origin + step AS INTEGER) AS d_num, {repaired('sales + low', 'sales', 'sales + high')}
  FROM (SELECT unnest(generate_series(1, 28)) AS step) JOIN history h ON 7 - h.back = (step - 1) % 7
  JOIN bands ON bands.origin = h.origin AND bands.id = h.id WHERE h.back <= 7 AND h.n >= 7)"""

TREND = f"""
lines_fit AS (
  SELECT origin, id, regr_slope(sales, d_num) AS b, regr_intercept(sales, d_num) AS a
  FROM history WHERE n >= 14 GROUP BY origin, id),
detrended AS (
  SELECT h.origin, h.id, h.d_num, d_num % 7 AS wd, sales - (a + b * d_num) AS e FROM history h
  JOIN lines_fit f ON f.origin = h.origin AND f.id = h.id),
weekdays AS (SELECT origin, id, wd, avg(e) AS effect FROM detrended GROUP BY origin, id, wd),
spread AS (
  SELECT d.origin, d.id, stddev_samp(e - effect) AS sigma FROM detrended d
  JOIN weekdays w ON w.origin = d.origin AND w.id = d.id AND w.wd = d.wd GROUP BY d.origin, d.id),
centre AS (
  SELECT f.origin, f.id, CAST(f.origin + step AS INTEGER) AS d_num, sigma,
         a + b * (f.origin + step) + coalesce(effect, 0) AS yhat
  FROM lines_fit f CROSS JOIN (SELECT unnest(generate_series(1, 28)) AS step)
  JOIN spread s ON s.origin = f.origin AND s.id = f.id
  LEFT JOIN weekdays w ON w.origin = f.origin AND w.id = f.id AND w.wd = (f.origin + step) % 7),
trend AS (
  SELECT origin, id, d_num,
         {repaired('yhat - 1.2815515655446004 * sigma', 'yhat', 'yhat + 1.2815515655446004 * sigma')} FROM centre)"""


def loss(q: str, level: float) -> str:
    return f"greatest({level} * (sales - {q}), ({level} - 1) * (sales - {q}))"


def scores(forecast: str, rows: str) -> str:
    """Scored rows, then one row per model, origin and series. ``forecast`` selects model and quantiles."""
    return f"""
forecasts AS ({forecast}),
scored AS MATERIALIZED (
  SELECT f.*, p.sales FROM forecasts f JOIN {rows} p ON p.id = f.id AND p.d_num = f.d_num),
scales AS (SELECT origin, id, avg(abs(resid)) AS scale FROM history GROUP BY origin, id),
losses AS (
  SELECT model, s.origin, s.id, sum({loss('q10', 0.1)}) AS l1, sum({loss('q50', 0.5)}) AS l5,
         sum({loss('q90', 0.9)}) AS l9, sum(abs(sales)) AS demand,
         CASE WHEN any_value(scale) > 0 THEN avg(abs(sales - q50)) / any_value(scale) END AS mase, any_value(scale) AS scale
  FROM scored s JOIN scales ON scales.origin = s.origin AND scales.id = s.id GROUP BY model, s.origin, s.id)"""


SCORE = "count(*) AS n_series, 2 * (sum(l1) + sum(l5) + sum(l9)) / 3 / nullif(sum(demand), 0) AS wql, avg(mase) AS mase"
NAIVE_ONLY = "SELECT 'seasonal_naive' AS model, * FROM naive"
BOTH_MODELS = NAIVE_ONLY + " UNION ALL SELECT 'trend_weekly', * FROM trend"

SEGMENTS = f"""
volume AS (SELECT id, CAST(sum(sales) AS DOUBLE) / count(*) AS avg_daily_sales FROM panel WHERE split = 'train' GROUP BY id),
segments AS (
  SELECT id, avg_daily_sales, CASE WHEN avg_daily_sales >=
    (SELECT {nearest('l', 0.8)} FROM (SELECT list_sort(list(avg_daily_sales)) AS l FROM volume))
    THEN 'high_volume' ELSE 'long_tail' END AS volume_segment FROM volume)"""

RESULTS = f"""
results AS (
  SELECT model, origin, 'overall' AS segment, {SCORE} FROM losses GROUP BY model, origin
  UNION ALL
  SELECT model, origin, volume_segment, {SCORE} FROM losses JOIN segments USING (id) GROUP BY model, origin, volume_segment)"""
SHOW_RESULTS = f"model, CAST(origin AS BIGINT) AS origin, segment, n_series, {rounded('wql', 'mase')}"


def sample(name: str, rows: str, n: str, seed: int) -> str:
    return f"""
{name} AS (
  SELECT id, cat_id FROM (
    SELECT id, cat_id, row_number() OVER (PARTITION BY cat_id ORDER BY md5(id || '{seed}'), id) AS place,
           round_even(least(1.0::DOUBLE, {n} / CAST(count(*) OVER () AS DOUBLE)) * count(*) OVER (PARTITION BY cat_id), 0) AS quota
    FROM (SELECT DISTINCT id, cat_id FROM {rows}))
  WHERE place <= quota)"""


def cold(rows: str, frac: float) -> str:
    return sample("cold", rows, f"(SELECT round_even(CAST({frac} AS DOUBLE) * count(DISTINCT id), 0) FROM {rows})", 44)


def truncated(rows: str) -> str:
    return f"""
cut AS (
  SELECT * FROM {rows}
  WHERE id NOT IN (SELECT id FROM cold) OR d_num >= (SELECT cutoff FROM bounds))"""


BACKTEST = [ORIGINS, history("trainval"), NAIVE, TREND, scores(BOTH_MODELS, "trainval"), SEGMENTS, RESULTS]
NAIVE_SCORES = [ORIGINS, history("trainval"), NAIVE, scores(NAIVE_ONLY, "trainval")]

# --- sources and ingest -------------------------------------------------------------------------------

sql("daily_demand", "fine", [], "SELECT * FROM daily")
sql("daily_demand_coarse", "coarse", [], "SELECT * FROM daily")
sql("calendar_dim", "coarse", [], "SELECT * FROM calendar")
sql("sell_prices", "fine", [], f"SELECT store_id, item_id, wm_yr_wk, {rounded('sell_price')} FROM prices")
sql("scan_csv", "fine", [], f"SELECT id, d_num, date, sales, {rounded('sell_price')}, event_name_1, split FROM panel")
sql("melt_sales", "coarse", [], "SELECT id, item_id, dept_id, cat_id, store_id, state_id, d, sales, d_num FROM long")
sql("join_calendar", "coarse", [], """SELECT id, d_num, sales, d, date, wm_yr_wk, weekday, wday, month, year,
  event_name_1, event_type_1, event_name_2, event_type_2, "snap_CA", "snap_TX", "snap_WI" FROM joined""")
sql("join_prices", "fine", [], f"SELECT id, d_num, wm_yr_wk, {rounded('sell_price')} FROM joined")
sql("drop_pre_release", "fine", [], f"SELECT id, d_num, sales, {rounded('sell_price')} FROM joined WHERE sell_price IS NOT NULL")
sql("pre_release_stats", "fine", [], """SELECT count(*) AS rows_before, count(sell_price) AS rows_after,
  count(*) - count(sell_price) AS rows_dropped,
  round(100.0::DOUBLE * (count(*) - count(sell_price)) / count(*), 2) + 0.0 AS pct_dropped FROM joined""")
sql("assign_split", "fine", [], "SELECT id, d_num, split FROM panel")
sql("split_profile", "fine", [], """SELECT split, count(*) AS rows, min(d_num) AS min_day, max(d_num) AS max_day,
  count(DISTINCT id) AS n_series FROM panel GROUP BY split""")
sql("load_panel", "coarse", [], "SELECT id, cat_id, d_num, sales, date FROM trainval")
sql("parquet_roundtrip", "coarse", [], f"SELECT id, d_num, sales, {rounded('sell_price')}, split FROM panel")
sql("csv_roundtrip", "coarse", BACKTEST, f"SELECT {SHOW_RESULTS} FROM results")
sql("series_dim", "fine", [], "SELECT DISTINCT id, item_id, dept_id, cat_id, store_id, state_id FROM panel")

# --- features and series sets -------------------------------------------------------------------------

SNAP = """CASE state_id WHEN 'CA' THEN "snap_CA" WHEN 'TX' THEN "snap_TX" WHEN 'WI' THEN "snap_WI" ELSE 0 END"""
PRICE_FLAG = "CASE WHEN sell_price <> lag(sell_price) OVER s THEN 1 ELSE 0 END"
COLD_FLAG = "CASE WHEN d_num - min(d_num) OVER (PARTITION BY id) + 1 < 28 THEN 1 ELSE 0 END"
ROLLING = ", ".join(
    f"avg(sales) OVER w{w} AS rolling_mean_{w}, coalesce(stddev_samp(sales) OVER w{w}, 0) AS rolling_std_{w}" for w in (7, 28)
)
WINDOWS = "WINDOW s AS (PARTITION BY id ORDER BY d_num), " + ", ".join(
    f"w{w} AS (PARTITION BY id ORDER BY d_num ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in (7, 28)
)
ROLLED = ["rolling_mean_7", "rolling_std_7", "rolling_mean_28", "rolling_std_28"]


def engineered(rows: str) -> str:
    return f"""
engineered AS MATERIALIZED (
  SELECT id, cat_id, d_num, CAST(sales AS DOUBLE) AS sales, sell_price, {SNAP} AS snap, wday, month, year,
         {PRICE_FLAG} AS price_change_flag, {COLD_FLAG} AS coldstart_flag, {ROLLING},
         lag(sales, 7) OVER s AS lag_7, lag(sales, 28) OVER s AS lag_28 FROM {rows} {WINDOWS})"""


ENGINEERED = f"""id, d_num, {rounded('sales', 'sell_price')}, snap, wday, month, year, price_change_flag,
  coldstart_flag, {rounded(*ROLLED)}"""

sql("snap_flag", "coarse", [], f"SELECT id, d_num, {SNAP} AS snap FROM panel")
sql("price_change_flag", "coarse", [], f"SELECT id, d_num, {PRICE_FLAG} AS price_change_flag FROM panel {WINDOWS}")
sql("rolling_features", "coarse", [f"f AS (SELECT id, d_num, {ROLLING} FROM panel {WINDOWS})"],
    f"SELECT id, d_num, {rounded(*ROLLED)} FROM f")
sql("lag_features", "coarse", [], f"SELECT id, d_num, sales, lag(sales, 7) OVER s AS lag_7, lag(sales, 28) OVER s AS lag_28 FROM panel {WINDOWS}")
sql("coldstart_flag", "coarse", [], f"SELECT id, d_num, {COLD_FLAG} AS coldstart_flag FROM panel")
sql("engineer_features", "coarse", [engineered("trainval")], f"SELECT {ENGINEERED} FROM engineered")
sql("engineer_features_recent", "coarse", [engineered("trainval")],
    f"SELECT {ENGINEERED} FROM engineered WHERE d_num >= (SELECT train_end - 365 FROM bounds)")
sql("engineer_features_coldstart", "coarse", [cold("panel", 0.2), truncated("trainval"), engineered("cut")],
    f"SELECT {ENGINEERED} FROM engineered")
sql("incremental_features", "coarse", [engineered("trainval")], f"SELECT {ENGINEERED}, {rounded('lag_7', 'lag_28')} FROM engineered")
sql("restrict_series", "coarse", [sample("chosen", "panel", "12", 42)],
    "SELECT id, d_num, sales FROM panel WHERE id IN (SELECT id FROM chosen)")
CODED = STATIC_CATEGORICALS + CALENDAR_CATEGORICALS
sql("encode_categoricals", "coarse", [
    f"dict_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT {c} AS v FROM panel WHERE split = 'train'))"
    for c in CODED
], "SELECT id, d_num, " + ", ".join(f"coalesce(dict_{c}.code, (SELECT count(*) FROM dict_{c})) AS {c}_code" for c in CODED)
    + " FROM panel " + " ".join(f"LEFT JOIN dict_{c} ON dict_{c}.v = panel.{c}" for c in CODED))
sql("encode_ids", "fine", ["""codes AS (SELECT id, dense_rank() OVER (ORDER BY id) - 1 AS code FROM (
  SELECT DISTINCT id FROM panel WHERE split = 'train' AND length(id) % 2 = 0))"""],
    """SELECT p.id, coalesce(code, (SELECT count(*) FROM codes)) AS code FROM (SELECT DISTINCT id FROM panel) p LEFT JOIN codes ON codes.id = p.id""")
sql("encode_store_items", "fine", [], """SELECT store_id, item_id, dense_rank() OVER (ORDER BY store_id, item_id) - 1 AS code
  FROM (SELECT DISTINCT store_id, item_id FROM panel)""")
sql("stratified_sample_series", "fine", [sample("chosen", "panel", "100", 42)], "SELECT id, cat_id FROM chosen")
sql("coldstart_sample", "fine", [cold("panel", 0.05)], "SELECT id, cat_id FROM cold")
sql("coldstart_truncate", "coarse", [cold("panel", 0.2), truncated("panel")], "SELECT id, d_num, sales FROM cut")

# --- metrics ------------------------------------------------------------------------------------------

sql("volume_segment", "fine", [SEGMENTS], f"SELECT id, {rounded('avg_daily_sales')}, volume_segment FROM segments")
sql("exact_threshold", "fine", [SEGMENTS, "every AS (SELECT list_sort(list(avg_daily_sales)) AS l FROM segments)"],
    " UNION ALL ".join(f"SELECT {x}::DOUBLE AS level, {r(nearest('l', f'{x}::DOUBLE'))} AS threshold FROM every" for x in (0.1, 0.5, 0.8, 0.9)))
sql("residual_bands", "coarse", NAIVE_SCORES + [SEGMENTS, """judged AS (
  SELECT CAST(d_num - origin AS INTEGER) AS h, volume_segment, list_sort(list(CAST(sales - q50 AS DOUBLE))) AS l
  FROM scored JOIN segments USING (id) GROUP BY ALL)"""],
    f"""SELECT h, volume_segment, {r('l[CAST(ceil(0.1 * len(l)) AS INTEGER)]')} AS low,
  {r('l[CAST(ceil(0.9 * len(l)) AS INTEGER)]')} AS high FROM judged""")
DIFFS = "diffs AS (SELECT id, sales - lag(sales, 7) OVER (PARTITION BY id ORDER BY d_num) AS resid FROM trainval)"
sql("resid_quantiles", "coarse", [DIFFS],
    f"SELECT id, {nearest('l', 0.1)} AS resid_q10, {nearest('l', 0.9)} AS resid_q90 FROM "
    "(SELECT id, list_sort(list(resid)) AS l FROM diffs WHERE resid IS NOT NULL GROUP BY id)")
sql("repair_forecast_quantiles", "coarse", [
    f"f AS (SELECT id, d_num, {ROLLING} FROM panel {WINDOWS})",
    "p AS (SELECT id, d_num, "
    + repaired("rolling_mean_7 - 1.5 * rolling_std_7", "rolling_mean_28", "rolling_mean_7 + 0.5 * rolling_std_7")
    + " FROM f WHERE rolling_mean_7 IS NOT NULL)"],
    f"SELECT id, d_num, {rounded('q10', 'q50', 'q90')} FROM p")
sql("score_join", "coarse", NAIVE_SCORES,
    f"SELECT CAST(origin AS BIGINT) AS origin, id, d_num, sales, {rounded('q10', 'q50', 'q90')} FROM scored")
sql("pinball_loss", "coarse", NAIVE_SCORES, "SELECT CAST(origin AS BIGINT) AS origin, id, d_num, "
    + ", ".join(f"{r(loss(q, level))} AS loss_{q}" for q, level in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))) + " FROM scored")
sql("wql", "coarse", NAIVE_SCORES + [f"s AS (SELECT origin, {SCORE} FROM losses GROUP BY origin)"],
    f"SELECT CAST(origin AS BIGINT) AS origin, n_series, {rounded('wql')} FROM s")
sql("mase_scale", "coarse", [DIFFS], f"SELECT id, {r('avg(abs(resid))')} AS scale FROM diffs WHERE resid IS NOT NULL GROUP BY id")
sql("mase_per_series", "coarse", NAIVE_SCORES,
    f"SELECT CAST(origin AS BIGINT) AS origin, id, {rounded('scale', 'mase')} FROM losses")
sql("mase", "coarse", NAIVE_SCORES,
    f"SELECT CAST(origin AS BIGINT) AS origin, count(mase) AS n_defined, {r('avg(mase)')} AS mase FROM losses GROUP BY origin")

# --- forecasts ----------------------------------------------------------------------------------------

sql("generate_origins_table", "coarse", [ORIGINS], "SELECT CAST(origin AS BIGINT) AS origin FROM origins")
sql("horizon_grid", "coarse", [], """SELECT id, train_end AS origin, CAST(h AS INTEGER) AS h, (h - 1) % 7 AS pattern_idx, train_end + h AS d_num
  FROM (SELECT DISTINCT id FROM panel) CROSS JOIN bounds CROSS JOIN (SELECT unnest(generate_series(1, 28)) AS h)""")
sql("last_pattern", "coarse", [VAL_ORIGIN, history("trainval")], "SELECT id, 7 - back AS pattern_idx, sales FROM history WHERE back <= 7 AND n >= 7")
FORECAST = f"CAST(origin AS BIGINT) AS origin, id, CAST(d_num AS BIGINT) AS d_num, {rounded('q10', 'q50', 'q90')}"
sql("seasonal_naive", "coarse", [ORIGINS, history("trainval"), NAIVE], f"SELECT {FORECAST} FROM naive")
sql("trend_weekly", "coarse", [ORIGINS, history("trainval"), TREND], f"SELECT {FORECAST} FROM trend")

FOLDED = [ORIGINS, """placed_days AS MATERIALIZED (
  SELECT id, CAST(sales AS DOUBLE) AS v, row_number() OVER (PARTITION BY id ORDER BY d_num) AS place FROM trainval
  WHERE d_num <= (SELECT max(origin) FROM origins))""", """ys AS MATERIALIZED (
  SELECT id, list(CAST(sales AS DOUBLE) ORDER BY d_num) AS y, list(d_num ORDER BY d_num) AS days FROM trainval
  WHERE d_num <= (SELECT max(origin) FROM origins) GROUP BY id HAVING count(*) >= 14)""", """
settings AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY alpha, beta, gamma, phi) - 1 AS INTEGER) AS setting, * FROM
    (SELECT unnest([0.05::DOUBLE, 0.2, 0.5]) AS alpha), (SELECT unnest([0.0::DOUBLE, 0.02]) AS beta),
    (SELECT unnest([0.05::DOUBLE, 0.2]) AS gamma), (SELECT unnest([0.9::DOUBLE, 0.98]) AS phi))""", """
states AS (
  SELECT id, setting, 7 AS n, list_sum(y[1:7]) / 7 AS level, (list_sum(y[8:14]) / 7 - list_sum(y[1:7]) / 7) / 7 AS trend,
         list_transform(y[1:7], lambda v: v - list_sum(y[1:7]) / 7) AS cycle, 0.0::DOUBLE AS sse FROM ys, settings
  UNION ALL
  SELECT id, setting, n + 1, level + phi * trend + alpha * e, phi * trend + beta * e, list_append(cycle[2:7], cycle[1] + gamma * e), sse + e * e
  FROM (SELECT s.*, alpha, beta, gamma, phi, v - (level + phi * trend + cycle[1]) AS e
        FROM states s JOIN placed_days ON placed_days.id = s.id AND place = s.n + 1 JOIN settings g ON g.setting = s.setting))""", """
fitted AS MATERIALIZED (
  SELECT o.origin, s.* FROM origins o JOIN ys ON true JOIN states s ON s.id = ys.id AND s.n = len(list_filter(days, lambda d: d <= o.origin))
  WHERE s.n >= 14 QUALIFY row_number() OVER (PARTITION BY o.origin, s.id ORDER BY sse, s.setting) = 1)"""]
sql("holt_winters_state", "coarse", FOLDED, f"""SELECT CAST(origin AS BIGINT) AS origin, id, n, setting, {rounded('level', 'trend')},
  {r('cycle[1]')} AS next_cycle, {r('cycle[7]')} AS last_cycle, {rounded('sse')} FROM fitted""")
sql("holt_winters_bands", "coarse", FOLDED + ["""
effects AS (
  SELECT setting, j, alpha + beta * list_sum(list_transform(generate_series(1, j), lambda i: phi ** i)) + CASE WHEN j % 7 = 0 THEN gamma ELSE 0 END AS c
  FROM settings, (SELECT unnest(generate_series(1, 28)) AS j))""", """
ahead AS (
  SELECT f.*, h, level + trend * list_sum(list_transform(generate_series(1, h), lambda i: phi ** i)) + cycle[(h - 1) % 7 + 1] AS point,
         sqrt(sse / (n - 7) * (1 + coalesce((SELECT sum(c * c) FROM effects e WHERE e.setting = f.setting AND e.j < h), 0))) AS sigma
  FROM fitted f JOIN settings g ON g.setting = f.setting, (SELECT unnest(generate_series(1, 28)) AS h))""", f"""
bands_out AS (SELECT origin, id, CAST(origin + h AS BIGINT) AS d_num,
  {repaired('point - 1.2815515655446004 * sigma', 'point', 'point + 1.2815515655446004 * sigma')} FROM ahead)"""],
    f"SELECT CAST(origin AS BIGINT) AS origin, id, d_num, {rounded('q10', 'q50', 'q90')} FROM bands_out")
for folded in ("holt_winters_state", "holt_winters_bands"):
    ORACLES[folded] = ORACLES[folded].replace("WITH ", "WITH RECURSIVE ", 1)

# --- training data ------------------------------------------------------------------------------------

CANDIDATES = """
candidates AS (
  SELECT e.* FROM engineered e, bounds, (SELECT min(d_num) AS lo FROM trainval WHERE d_num <= (SELECT train_end FROM bounds))
  WHERE d_num BETWEEN greatest(lo, train_end - 180) AND train_end - 28 AND (d_num - greatest(lo, train_end - 180)) % 7 = 0)"""


def horizon_join(rows: str) -> str:
    return f"""
pairs AS (
  SELECT c.*, t.place - b.place AS h, t.d_num AS target_day, CAST(t.sales AS DOUBLE) AS target
  FROM candidates c JOIN placed b ON b.id = c.id AND b.d_num = c.d_num
  JOIN placed t ON t.id = c.id AND t.place BETWEEN b.place + 1 AND b.place + 28
  WHERE t.d_num <= (SELECT train_end FROM bounds)),
checked AS (SELECT * FROM pairs)"""


def placed(rows: str) -> str:
    return f"placed AS (SELECT id, d_num, sales, row_number() OVER (PARTITION BY id ORDER BY d_num) AS place FROM {rows})"


sql("training_panel", "coarse", [engineered("trainval"), CANDIDATES, placed("trainval"), horizon_join("trainval")],
    f"SELECT id, d_num, h, {rounded('target', 'rolling_mean_28', 'lag_7', 'sell_price')}, wday FROM pairs")


def windows(rows: str, lag_rows: int, min_encoder: int) -> str:
    return f"""
usable AS (SELECT * FROM placed WHERE place > {lag_rows}),
windows AS (
  SELECT id, min(d_num) OVER e AS encoder_start, d_num AS decoder_start, max(d_num) OVER d AS decoder_end,
         count(*) OVER e AS encoder_len, count(*) OVER d AS decoder_len,
         sum(sales) OVER e AS encoder_sum, sum(sales) OVER d AS decoder_sum,
         lag(sales) OVER s AS encoder_last, sales AS decoder_first, max(d_num) OVER (PARTITION BY id) AS last_day
  FROM usable WINDOW s AS (PARTITION BY id ORDER BY d_num),
    e AS (PARTITION BY id ORDER BY d_num ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING),
    d AS (PARTITION BY id ORDER BY d_num ROWS BETWEEN CURRENT ROW AND 27 FOLLOWING)
  QUALIFY count(*) OVER e >= {min_encoder})"""


WINDOW_COLUMNS = """id, encoder_start, decoder_start, decoder_end, CAST(encoder_len AS INTEGER) AS encoder_len,
  CAST(decoder_len AS INTEGER) AS decoder_len, CAST(encoder_sum AS BIGINT) AS encoder_sum,
  CAST(decoder_sum AS BIGINT) AS decoder_sum, encoder_last, decoder_first"""
sql("training_windows", "coarse", [placed("trainval"), windows("trainval", 0, 30)], f"SELECT {WINDOW_COLUMNS} FROM windows")
sql("training_windows_predict", "coarse", [placed("trainval"), windows("trainval", 0, 1)],
    f"SELECT {WINDOW_COLUMNS} FROM windows WHERE decoder_len = 28 AND decoder_end = last_day")
WINDOW_FRAMES = """WINDOW s AS (PARTITION BY id ORDER BY d_num), e AS (PARTITION BY id ORDER BY d_num ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING),
    d AS (PARTITION BY id ORDER BY d_num ROWS BETWEEN CURRENT ROW AND 27 FOLLOWING) QUALIFY count(*) OVER e >= 30"""
sql("window_index", "coarse", [], f"""SELECT id, CAST(row_number() OVER s - count(*) OVER e AS INTEGER) AS first_row, CAST(count(*) OVER e AS INTEGER) AS encoder_len,
  CAST(count(*) OVER d AS INTEGER) AS decoder_len FROM trainval {WINDOW_FRAMES}""")
SLICES = ", ".join(f"sum({c}) OVER {w} AS {side}_{c}_sum" for c in ("sales", "sell_price", "wday") for side, w in (("encoder", "e"), ("decoder", "d")))
sql("window_values", "coarse", [f"""slices AS (
  SELECT id, row_number() OVER s - count(*) OVER e AS first_row, {SLICES}, lag(sales) OVER s AS encoder_last, sales AS decoder_first
  FROM trainval {WINDOW_FRAMES})"""],
    "SELECT id, CAST(first_row AS INTEGER) AS first_row, "
    + rounded(*[f"{side}_{c}_sum" for c in ("sales", "sell_price", "wday") for side in ("encoder", "decoder")]) + ", encoder_last, decoder_first FROM slices")
TRAIN_CUT = "train_cut AS (SELECT * FROM cut WHERE d_num <= (SELECT train_end FROM bounds))"
COLD_CUT = [cold("(SELECT * FROM panel WHERE split = 'train')", 0.05), truncated("trainval")]
sql("dropped_series", "fine", COLD_CUT + [TRAIN_CUT, placed("train_cut"), windows("train_cut", 28, 30)],
    "SELECT id, count(*) AS n_rows FROM train_cut WHERE id NOT IN (SELECT id FROM windows) GROUP BY id")
sql("series_scale", "fine", [], f"SELECT id, {r('greatest(avg(sales), 0.000001)')} AS scale FROM panel WHERE split = 'train' GROUP BY id")
sql("leakage_audit", "fine", COLD_CUT + [
    LAST_ORIGIN, history("cut"), NAIVE, engineered("cut"), CANDIDATES, placed("cut"), horizon_join("cut"),
    "cold_rows AS (SELECT * FROM cut WHERE id IN (SELECT id FROM cold))",
    """weekly_seen AS (
  SELECT store_id, item_id, (d_num - 1) // 7 + 1 AS wm_yr_wk, CAST(sum(cents) AS BIGINT) // CAST(sum(sales) AS BIGINT) / 100.0 AS paid
  FROM daily WHERE d_num <= (SELECT train_end FROM bounds) GROUP BY ALL)""",
    """repriced AS (
  SELECT k.*, (SELECT arg_max(CAST(paid AS DOUBLE), w.wm_yr_wk) FROM weekly_seen w
               WHERE w.store_id = k.store_id AND w.item_id = k.item_id AND w.wm_yr_wk < k.wm_yr_wk) AS price_by_origin
  FROM (SELECT DISTINCT store_id, item_id, wm_yr_wk, sell_price FROM cut, bounds
        WHERE d_num > train_end - 28 AND wm_yr_wk <= (train_end - 1) // 7 + 1) k)""",
    windows("cold_rows", 0, 1).replace("FROM placed", "FROM (SELECT id, d_num, sales, row_number() OVER (PARTITION BY id ORDER BY d_num) AS place FROM cold_rows)")],
    """SELECT 'cold_history_before_cutoff' AS rule, count(*) AS rows_checked, count(*) FILTER (WHERE d_num < (SELECT cutoff FROM bounds)) AS violations FROM cold_rows
UNION ALL SELECT 'cold_window_before_cutoff', count(*), count(*) FILTER (WHERE encoder_start < (SELECT cutoff FROM bounds)) FROM windows
UNION ALL SELECT 'target_past_origin', count(*), count(*) FILTER (WHERE target_day > (SELECT train_end FROM bounds)) FROM pairs
UNION ALL SELECT 'training_target_inside_held_out', count(*), count(*) FILTER (WHERE target_day >=
    (SELECT min(target_day) FROM pairs WHERE d_num > (SELECT train_end - 56 FROM bounds)))
  FROM pairs WHERE d_num <= (SELECT train_end - 84 FROM bounds)
UNION ALL SELECT 'price_from_later_sales', count(*), count(*) FILTER (WHERE sell_price IS DISTINCT FROM price_by_origin) FROM repriced
UNION ALL SELECT 'forecast_inside_history', count(*), count(*) FILTER (WHERE d_num <= origin) FROM naive""")

COUNT_MEAN = """-0.5 + 0.125 * log_lag_1 + 0.25 * log_lag_7 + 0.125 * log_lag_28 + 0.25 * log_mean_7 + 0.25 * log_mean_28 + 0.0625 * log_scale
  + 0.0625 * snap + CASE WHEN wday > 1 THEN wday / 64.0::DOUBLE ELSE 0 END + CASE state_id WHEN 'TX' THEN 0.125 WHEN 'WI' THEN -0.25 ELSE 0 END"""
sql("count_one_step", "coarse", [f"""terms AS (
  SELECT id, d_num, wday, state_id, {SNAP} AS snap, ln(1 + lag(sales, 1) OVER s) AS log_lag_1, ln(1 + lag(sales, 7) OVER s) AS log_lag_7,
         ln(1 + lag(sales, 28) OVER s) AS log_lag_28, ln(1 + avg(sales) OVER w7) AS log_mean_7, ln(1 + avg(sales) OVER w28) AS log_mean_28,
         ln(1 + coalesce(avg(CASE WHEN d_num <= train_end THEN sales END) OVER (PARTITION BY id), 0)) AS log_scale, count(sales) OVER w28 AS n_before
  FROM trainval, bounds {WINDOWS})"""],
    f"SELECT id, d_num, {rounded('log_lag_28', 'log_mean_7', 'log_scale')}, {r(f'exp({COUNT_MEAN})')} AS mean FROM terms WHERE n_before = 28")

sql("global_predict_rows", "fine", ["""ahead AS (
  SELECT s.*, CAST(NULL AS INTEGER) AS sales, a.d_num, wday, month, year, "snap_CA", "snap_TX", "snap_WI", sell_price
  FROM (SELECT DISTINCT id, item_id, dept_id, cat_id, store_id, state_id FROM panel) s CROSS JOIN all_days a JOIN calendar c ON c.d = 'd_' || a.d_num
  LEFT JOIN prices p ON p.store_id = s.store_id AND p.item_id = s.item_id AND p.wm_yr_wk = c.wm_yr_wk WHERE a.d_num > (SELECT m FROM bounds))""", """
extended AS MATERIALIZED (SELECT id, cat_id, state_id, d_num, sales, sell_price, wday, month, year, "snap_CA", "snap_TX", "snap_WI" FROM panel
  UNION ALL SELECT id, cat_id, state_id, d_num, sales, sell_price, wday, month, year, "snap_CA", "snap_TX", "snap_WI" FROM ahead)""",
    engineered("extended"),
    "starts AS (SELECT train_end AS origin FROM bounds UNION ALL SELECT val_end FROM bounds UNION ALL SELECT m FROM bounds)",
    "based AS MATERIALIZED (SELECT e.*, origin, unnest(generate_series(1, 28)) AS step FROM engineered e JOIN starts ON e.d_num = origin)"],
    f"""SELECT origin, e.id, CAST(step AS INTEGER) AS h, t.d_num AS target_day, {r('e.sell_price')} AS sell_price, e.snap,
  e.coldstart_flag, {r('e.rolling_mean_7')} AS rolling_mean_7, {r('e.rolling_std_28')} AS rolling_std_28, {r('e.lag_7')} AS lag_7, {r('e.lag_28')} AS lag_28
  FROM based e JOIN extended t ON t.id = e.id AND t.d_num = origin + step""")
sql("recent_mean", "coarse", [ORIGINS, history("trainval"), """recent AS (
  SELECT origin, id, CAST(min(sales) AS DOUBLE) AS lo, avg(sales) AS mid, CAST(max(sales) AS DOUBLE) AS hi
  FROM history WHERE back <= 28 AND n >= 28 GROUP BY origin, id)"""],
    f"""SELECT CAST(origin AS BIGINT) AS origin, id, CAST(origin + step AS BIGINT) AS d_num, {r('lo')} AS q10, {r('mid')} AS q50, {r('hi')} AS q90
  FROM recent, (SELECT unnest(generate_series(1, 28)) AS step)""")

# --- backtest reports ---------------------------------------------------------------------------------

sql("score_forecast", "coarse", [LAST_ORIGIN, history("trainval"), NAIVE, scores(NAIVE_ONLY, "trainval"),
    f"s AS (SELECT model, origin, {SCORE} FROM losses GROUP BY model, origin)"],
    f"SELECT model, CAST(origin AS BIGINT) AS origin, n_series, {rounded('wql', 'mase')} FROM s")
sql("backtest_results", "coarse", BACKTEST, f"SELECT {SHOW_RESULTS} FROM results")
sql("backtest_summary", "coarse", BACKTEST, f"""SELECT model, segment, {r('avg(wql)')} AS wql_mean, {r('stddev_samp(wql)')} AS wql_std,
  {r('avg(mase)')} AS mase_mean, {r('stddev_samp(mase)')} AS mase_std, {r('avg(n_series)')} AS avg_n_series,
  count(*) AS n_origins, count(*) FILTER (WHERE wql IS NULL OR mase IS NULL) AS n_undefined FROM results GROUP BY model, segment""")
sql("model_comparison", "coarse", BACKTEST, f"""SELECT model, n_series, {rounded('wql', 'mase')} FROM results
  WHERE segment = 'overall' AND origin = (SELECT max(origin) FROM origins)""")
COLD_SCORES = COLD_CUT + [LAST_ORIGIN, history("cut"), NAIVE, scores(NAIVE_ONLY, "cut"), SEGMENTS, f"""
tagged AS (SELECT losses.*, volume_segment, CASE WHEN id IN (SELECT id FROM cold) THEN 'cold_start' ELSE 'warm_start' END AS start
  FROM losses LEFT JOIN segments USING (id)),
report AS (
  SELECT model, origin, 'overall' AS segment_type, 'overall' AS segment, {SCORE} FROM tagged GROUP BY model, origin
  UNION ALL SELECT model, origin, 'start', start, {SCORE} FROM tagged GROUP BY model, origin, start
  UNION ALL SELECT model, origin, 'volume', volume_segment, {SCORE} FROM tagged WHERE volume_segment IS NOT NULL GROUP BY model, origin, volume_segment)"""]
sql("segmented_scores", "fine", COLD_SCORES,
    f"SELECT model, CAST(origin AS BIGINT) AS origin, segment_type, segment, n_series, {rounded('wql', 'mase')} FROM report")
METRIC = "SELECT model, origin, '{0}' AS metric, " + ", ".join(
    f"(round(CAST(max({{0}}) FILTER (WHERE segment = '{s}') AS DOUBLE), 6) + 0.0) AS {s}"
    for s in ("cold_start", "warm_start", "high_volume", "long_tail")
) + " FROM report GROUP BY model, origin"
sql("coldstart_comparison", "fine", COLD_SCORES, " UNION ALL ".join(METRIC.format(m) for m in ("n_series", "wql", "mase")))

# --- decisions: the day-by-day recursion, written as a recursive query ------------------------------------

MERGED = [VAL_ORIGIN, history("trainval"), NAIVE, """
merged AS MATERIALIZED (SELECT p.id, p.d_num, p.sales, p.sell_price, q10, q50, q90 FROM panel p JOIN naive n ON n.id = p.id AND n.d_num = p.d_num)"""]
POLICY = MERGED + ["""
numbered AS (
  SELECT policy, order_up_to, id, d_num, sales, sell_price, place,
         sum(target) OVER (PARTITION BY policy, id, place // 7) AS level
  FROM (SELECT policy, order_up_to, id, d_num, sales, sell_price, target,
               row_number() OVER (PARTITION BY policy, id ORDER BY d_num) - 1 AS place
        FROM (SELECT 'p90' AS policy, 'q0.9' AS order_up_to, id, d_num, sales, sell_price, q90 AS target FROM merged
              UNION ALL SELECT 'p50', 'q0.5', id, d_num, sales, sell_price, q50 FROM merged))),
steps AS (
  SELECT n.*, CAST(greatest(level, 0) AS DOUBLE) AS stock, CAST(greatest(greatest(level, 0) - sales, 0) AS DOUBLE) AS left_over
  FROM numbered n WHERE place = 0
  UNION ALL
  SELECT n.*, CAST(CASE WHEN n.place % 7 = 0 THEN greatest(s.left_over, n.level) ELSE s.left_over END AS DOUBLE) AS stock,
         CAST(greatest(CASE WHEN n.place % 7 = 0 THEN greatest(s.left_over, n.level) ELSE s.left_over END - n.sales, 0) AS DOUBLE)
  FROM steps s JOIN numbered n ON n.policy = s.policy AND n.id = s.id AND n.place = s.place + 1),
trace AS (
  SELECT policy, order_up_to, id, d_num, CAST(sales AS DOUBLE) AS demand, sell_price, stock AS inv_before, left_over AS inv_after,
         CASE WHEN sales > stock THEN 1 ELSE 0 END AS stockout, left_over * sell_price * (0.20::DOUBLE / 365) AS holding_cost FROM steps),
per_series AS (
  SELECT policy, order_up_to, id, count(*) AS n_days, CAST(sum(stockout) AS BIGINT) AS stockout_days,
         sum(holding_cost) AS holding_cost, sum(stockout) / CAST(count(*) AS DOUBLE) AS stockout_rate
  FROM trace GROUP BY policy, order_up_to, id),
summary AS (
  SELECT policy, order_up_to, count(*) AS n_series, avg(stockout_rate) AS mean_stockout_rate,
         avg(holding_cost) AS mean_holding_cost_per_series, sum(holding_cost) AS total_holding_cost
  FROM per_series GROUP BY policy, order_up_to)"""]


def recursive(name: str, select: str) -> None:
    sql(name, "coarse", POLICY, select)
    ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)


sql("policy_input", "coarse", MERGED, f"SELECT id, d_num, sales, {rounded('sell_price', 'q10', 'q50', 'q90')} FROM merged")
recursive("inventory_trace", f"""SELECT policy, order_up_to, id, d_num, {rounded('demand', 'sell_price', 'inv_before', 'inv_after')},
  stockout, {rounded('holding_cost')} FROM trace""")
recursive("policy_per_series", f"SELECT policy, order_up_to, id, n_days, stockout_days, {rounded('holding_cost', 'stockout_rate')} FROM per_series")
recursive("policy_summary", f"""SELECT policy, order_up_to, n_series,
  {rounded('mean_stockout_rate', 'mean_holding_cost_per_series', 'total_holding_cost')} FROM summary""")
recursive("policy_headline", f"""SELECT {r('a.mean_stockout_rate')} AS careful_stockout_rate, {r('b.mean_stockout_rate')} AS lean_stockout_rate,
  {r('b.mean_stockout_rate / nullif(a.mean_stockout_rate, 0)')} AS stockout_ratio,
  {r('a.total_holding_cost / nullif(b.total_holding_cost, 0)')} AS holding_cost_ratio, a.n_series
  FROM summary a, summary b WHERE a.policy = 'p90' AND b.policy = 'p50'""")

# --- reshaping and reports ----------------------------------------------------------------------------

sql("future_rows", "fine", [], f"""SELECT s.id, a.d_num, date, c.wm_yr_wk, weekday, coalesce(event_name_1, 'none') AS event_name_1,
  {rounded('sell_price')}, CAST(NULL AS INTEGER) AS sales
  FROM (SELECT DISTINCT id, store_id, item_id FROM panel) s CROSS JOIN all_days a JOIN calendar c ON c.d = 'd_' || a.d_num
  LEFT JOIN prices p ON p.store_id = s.store_id AND p.item_id = s.item_id AND p.wm_yr_wk = c.wm_yr_wk
  WHERE a.d_num > (SELECT m FROM bounds)""")
sql("explode_forecast", "coarse", [ORIGINS, history("trainval"), NAIVE], f"SELECT {FORECAST} FROM naive")


def on_seen(part: str) -> str:
    """The same SQL on the rows ``seen`` instead of ``history``."""
    return re.sub(r"\bhistory\b", "seen", part)


BLEND = [BLOCK_ORIGINS, history("panel"), NAIVE, cold("(SELECT * FROM panel WHERE split = 'train')", 0.2),
    "visible AS (SELECT * FROM panel WHERE id NOT IN (SELECT id FROM cold) OR d_num >= (SELECT val_end - 9 FROM bounds))",
    on_seen(history("visible")), on_seen(TREND), """
blend AS (SELECT * FROM trend UNION ALL
  SELECT * FROM naive n WHERE NOT EXISTS (SELECT 1 FROM trend t WHERE t.origin = n.origin AND t.id = n.id))"""]
sql("blend_forecasts", "coarse", BLEND, f"SELECT {FORECAST} FROM blend")


def wide(rows: str, suffix: str, origin: str) -> str:
    steps = ", ".join(
        f"{r(f'max(q50) FILTER (WHERE d_num = {origin} + {i})')} AS \"F{i}\"" for i in range(1, 29)
    )
    return f"SELECT id || '_{suffix}' AS id, {steps} FROM {rows}, bounds WHERE origin = {origin} GROUP BY {rows}.id, {origin}"


sql("forecast_wide", "coarse", [VAL_ORIGIN, history("trainval"), NAIVE], wide("naive", "validation", "val_end"))
sql("submission_table", "coarse", BLEND, wide("blend", "validation", "val_end") + " UNION ALL " + wide("blend", "evaluation", "m"))


def report(frac: float) -> list[str]:
    return [cold("(SELECT * FROM panel WHERE split = 'train')", frac), VAL_ORIGIN, history("trainval"), NAIVE, SEGMENTS, """
report AS (
  SELECT p.id, p.cat_id, p.d_num, p.sales, q10, q50, q90, volume_segment, p.id IN (SELECT id FROM cold) AS is_coldstart
  FROM panel p LEFT JOIN naive n ON n.id = p.id AND n.d_num = p.d_num LEFT JOIN segments s ON s.id = p.id
  WHERE p.d_num > (SELECT val_end - 120 FROM bounds))"""]


sql("series_report", "coarse", report(0.2),
    f"SELECT id, cat_id, d_num, sales, {rounded('q10', 'q50', 'q90')}, volume_segment, is_coldstart FROM report")
sql("series_picker", "fine", report(0.05), "SELECT DISTINCT id, cat_id FROM report WHERE is_coldstart")
