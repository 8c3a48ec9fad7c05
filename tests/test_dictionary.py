"""Dense ids of values of any variety."""

import pytest

from tallycast.operators.dictionary import dense_ids, encode_ids


def test_ids_follow_the_order_over_many_ranges(spark):
    rows = [(f"v{i * 7919 % 5000:05d}", i % 3) for i in range(5000)] + [(None, 1), ("v00000", 0), ("v00000", 0)]
    df = spark.createDataFrame(rows, "v string, code int").repartition(9)
    ids = dense_ids(df, ["v"])
    assert [(r.v, r.code) for r in ids.orderBy("v").collect()] == [(f"v{i:05d}", i) for i in range(5000)]
    pairs = dense_ids(df.withColumnRenamed("code", "w"), ["w", "v"], "n").collect()
    assert [r.n for r in sorted(pairs, key=lambda r: (r.w, r.v))] == list(range(len(pairs)))


@pytest.mark.parametrize("unknown,expected", [(None, 2), (-1, -1)])
def test_unknown_values_and_nulls(spark, unknown, expected):
    ids = dense_ids(spark.createDataFrame([("b",), ("a",), (None,)], "v string"), ["v"])
    coded = encode_ids(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "v string"), ids, ["v"], unknown=unknown)
    assert {r.v: r.code for r in coded.collect()} == {"a": 0, "b": 1, "z": expected, None: expected}


def test_no_values(spark):
    empty = spark.createDataFrame([], "v string")
    assert dense_ids(empty, ["v"]).count() == 0
    coded = encode_ids(spark.createDataFrame([("a",)], "v string"), dense_ids(empty, ["v"]), ["v"])
    assert coded.first().code == 0
