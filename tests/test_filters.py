"""Numeric bounds on typed columns: exact for every type and value."""
from decimal import Decimal

from tablescope.operators.filters import apply_filters, filter_in_values


def kept(df, lim):
    return [r[0] for r in apply_filters(df, {"numeric_ranges": {"x": lim}}).collect()]


def test_bounds(spark):
    ints = spark.createDataFrame([(1,), (2,), (3,), (-2,), (None,)], "x int")
    assert kept(ints, {"min": 2.5}) == [3] and kept(ints, {"max": -1.5}) == [-2] and kept(ints, {"min": -2.5}) == [1, 2, 3, -2]
    assert kept(ints, {"max": 1e12}) == [1, 2, 3, -2] and kept(ints, {"min": 1e12}) == [] and kept(ints, {"max": -1e12}) == []
    assert kept(ints, {"min": float("-inf"), "max": float("inf")}) == [1, 2, 3, -2] and kept(ints, {"min": float("nan")}) == []
    longs = spark.createDataFrame([(2 ** 63 - 1,), (2 ** 53 + 1,), (-2 ** 63,)], "x long")
    assert kept(longs, {"min": 2 ** 53 + 1}) == [2 ** 63 - 1, 2 ** 53 + 1] and kept(longs, {"max": -2 ** 63}) == [-2 ** 63]
    dec = spark.createDataFrame([(Decimal("1.25"),), (Decimal("1.26"),)], "x decimal(5,2)")
    assert kept(dec, {"min": 1.255}) == [Decimal("1.26")] and kept(dec, {"max": 1e9}) == [Decimal("1.25"), Decimal("1.26")]
    floats = spark.createDataFrame([(0.5,), (float("nan"),), (float("inf"),)], "x double")
    assert kept(floats, {"min": 0}) == [0.5]


def test_value_list(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert [r[0] for r in filter_in_values(df, "x", ["a", "a", "z"]).collect()] == ["a"]
    assert filter_in_values(df, "x", []).count() == 0
