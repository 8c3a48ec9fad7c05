from pyspark.sql import functions as F

from tallycast.operators import coldstart, features
from tallycast.operators.sampling import stratified_sample


def by_day(df, column, sid="A"):
    return [r[column] for r in df.where(F.col("id") == sid).orderBy("d_num").collect()]


def test_snap_flag_follows_the_state(spark):
    df = spark.createDataFrame(
        [("A", 1, "CA", 1, 0, 0), ("B", 1, "TX", 0, 1, 0), ("C", 1, "WI", 0, 0, 1), ("D", 1, "NY", 1, 1, 1)],
        "id string, d_num int, state_id string, snap_CA int, snap_TX int, snap_WI int",
    )
    assert {r.id: r.snap for r in features.add_snap_flag(df).collect()} == {"A": 1, "B": 1, "C": 1, "D": 0}


def test_price_change(spark):
    df = spark.createDataFrame([("A", i, p) for i, p in enumerate([9.99, 9.99, 8.99, 8.99])], "id string, d_num int, sell_price double")
    assert by_day(features.add_price_change_flag(df), "price_change_flag") == [0, 0, 1, 0]


def test_rolling_excludes_today_and_other_series(spark):
    df = spark.createDataFrame(
        [("A", 1, 10), ("A", 2, 20), ("A", 3, 30), ("B", 1, 1), ("B", 2, 2)], "id string, d_num int, sales int"
    )
    out = features.add_rolling_features(df)
    assert by_day(out, "rolling_mean_7") == [None, 10.0, 15.0]
    assert by_day(out, "rolling_mean_7", "B") == [None, 1.0]
    assert by_day(out, "rolling_std_7")[:2] == [0.0, 0.0]


def test_coldstart_flag(spark):
    one = spark.createDataFrame([("A", d) for d in range(10, 15)], "id string, d_num int")
    assert by_day(features.add_coldstart_flag(one, 3), "coldstart_flag") == [1, 1, 0, 0, 0]
    two = spark.createDataFrame([("A", 1), ("A", 2), ("B", 100), ("B", 101)], "id string, d_num int")
    out = features.add_coldstart_flag(two, 2)
    assert by_day(out, "coldstart_flag") == [1, 0] and by_day(out, "coldstart_flag", "B") == [1, 0]


def test_truncation_only_touches_cold_series(spark):
    df = spark.createDataFrame([(s, d) for s in ("COLD", "WARM") for d in (1, 2, 3)], "id string, d_num int")
    cold = spark.createDataFrame([("COLD",)], "id string")
    out = coldstart.truncate_coldstart_history(df, cold, 2)
    assert by_day(out, "d_num", "COLD") == [2, 3] and by_day(out, "d_num", "WARM") == [1, 2, 3]


def test_cutoff_leaves_fewer_than_28_days():
    assert 1885 - coldstart.coldstart_cutoff_day(1885) + 1 == 27


def series(spark, counts):
    return spark.createDataFrame([(f"{c}{i}", c) for c, n in counts.items() for i in range(n)], "id string, cat_id string")


def test_stratified_sample_is_proportional_and_repeatable(spark):
    ids = series(spark, {"A": 30, "B": 20, "C": 10})
    drawn = stratified_sample(ids, 12, 42).collect()
    again = stratified_sample(ids.repartition(7), 12, 42).collect()
    assert sorted(drawn) == sorted(again)
    counts = {c: sum(r.cat_id == c for r in drawn) for c in "ABC"}
    assert counts == {"A": 6, "B": 4, "C": 2}


def test_stratified_sample_equals_a_plain_ranking(spark):
    import hashlib

    ids = series(spark, {"A": 3000, "B": 500, "C": 7})
    drawn = {r.id for r in stratified_sample(ids, 351, 9).collect()}
    expected = set()
    for c, n in {"A": 3000, "B": 500, "C": 7}.items():
        ranked = sorted((f"{c}{i}" for i in range(n)), key=lambda s: (hashlib.md5(f"{s}9".encode()).hexdigest(), s))
        expected |= set(ranked[: round(351 / 3507 * n)])
    assert drawn == expected


def test_coldstart_sample(spark):
    ids = series(spark, {"A": 100, "B": 100})
    drawn = coldstart.coldstart_sample(ids, 0.1, 44).collect()
    assert 15 <= len(drawn) <= 25 and {r.cat_id for r in drawn} == {"A", "B"}


def test_min_day_keeps_context_and_cold_history_is_gone(spark):
    rows = [("A", d, 1, "CA", 0, 0, 0, 1.0, 1, 1, 2000) for d in range(1, 41)]
    panel = spark.createDataFrame(
        rows, "id string, d_num int, sales int, state_id string, snap_CA int, snap_TX int, snap_WI int, "
        "sell_price double, wday int, month int, year int",
    )
    late = features.engineer_features(panel, min_day=40).first()
    assert late.rolling_mean_28 == 1.0 and late.coldstart_flag == 0
    cold = spark.createDataFrame([("A",)], "id string")
    first = features.engineer_features(panel, cold_ids=cold, cutoff_day=30).orderBy("d_num").first()
    assert (first.d_num, first.rolling_mean_28, first.coldstart_flag) == (30, None, 1)
