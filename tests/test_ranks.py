"""Radix order statistics against sorted lists: keys, weights, odd numbers."""
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.operators.freq import frequency_table
from tablescope.operators.profile import quantiles
from tablescope.operators.ranks import order_key, order_statistics

ODD = [0.0, -0.0, 1.0, -1.0, 0.1, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
       -1.7976931348623157e308, math.inf, -math.inf, 8.0, math.nextafter(8.0, 0), math.nextafter(8.0, 9), 1e300, 123456789.123456789, 3.0, 1024.0,
       math.nextafter(1024.0, 0), 2.0 ** 1000, math.nextafter(2.0 ** 1000, 0)]


def bits(x):
    raw = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -raw if x < 0 else raw


def test_key_is_the_number_in_order(spark):
    rng = random.Random(1)
    values = ODD + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(500)] + [2.0 ** k for k in range(-1074, 1024, 13)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {(r.x, math.copysign(1, r.x)): r.k for r in df.select("x", order_key(F.col("x")).alias("k")).collect()}
    assert all(k == bits(x) for (x, _), k in got.items())
    none = spark.createDataFrame([(None,), (math.nan,)], "x double").select(order_key(F.col("x")).alias("k"))
    assert [r.k for r in none.collect()] == [None, None]


def test_ranks_with_weights(spark):
    rng = random.Random(2)
    groups = {"odd": [(v, 1) for v in ODD], "same": [(7.5, 4)] * 9, "none": [(None, 3)], "one": [(-2.0, 1)],
              "many": [(rng.choice([rng.gauss(0, 1), 5.0, None]), rng.randint(1, 5)) for _ in range(3000)],
              "close": [(1e9 + k * 2.0 ** -22, 1) for k in range(2000)]}
    rows = [(g, v, w) for g, vs in groups.items() for v, w in vs]
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(7)
    at = (0.0, 0.1, 0.5, 0.99, 1.0)
    found = order_statistics(df, ["g"], lambda n: F.array(*[
        F.struct(F.lit(p).alias("p"), (F.floor((n - 1) * p) + 1).alias("k")) for p in at]), "v", "w").collect()
    want = {}
    for g, vs in groups.items():
        flat = sorted(v for v, w in vs if v is not None for _ in range(w))
        for p in at if flat else ():
            want[(g, p)] = (len(flat), flat[math.floor((len(flat) - 1) * p)])
    assert {(r.g, r.p): (r.n, r.value) for r in found} == want


def test_quantiles_of_many_distinct_values(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1e-3, 20_000), rng.integers(0, 9, 20_000) * 1.5
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    ps = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = {(r.column_name, r.p): r.value for r in quantiles(frequency_table(df), ["x", "y"], ps).collect()}
    for name, values in (("x", x), ("y", y)):
        for p in ps:
            assert got[(name, p)] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles(frequency_table(df), ["x"]).count() == 0
    assert quantiles(frequency_table(df.limit(0)), ["x"]).count() == 0


def test_missing_values_do_not_count(spark):
    """Null and NaN are left out before their key is worked out; the plan works a row's key out once."""
    from pyspark.sql import functions as F

    from tablescope.operators.ranks import order_statistics
    rows = spark.createDataFrame([("a", x, 1) for x in (3.0, None, float("nan"), 1.0, 2.0, float("inf"))], "c string, num double, cnt long")
    got = order_statistics(rows, ["c"], lambda n: F.array(F.struct(F.lit(4).cast("bigint").alias("k")))).collect()
    assert [(r["n"], r["value"]) for r in got] == [(4, float("inf"))]


def test_ranges_of_later_rounds(spark):
    rng = random.Random(9)
    # values with the same first bits, which only later rounds part; keys have different ranges
    rows = [("a", 1.5 + i * 1e-9) for i in range(20)] + [("b", 1.5 + i * 1e-12) for i in range(20)] + [
        (k, rng.choice([-1, 1]) * rng.uniform(2, 4) ** 9) for k in "ab" for _ in range(1000)] + [("a", -0.0), ("b", 0.0), ("a", None), (None, 3.0)]
    table = spark.createDataFrame(rows, "g string, num double").withColumn("cnt", F.lit(1))
    pick = lambda n: F.array(*[F.struct(F.lit(p).alias("p"), F.floor(n * p).cast("bigint").alias("k")) for p in (0.25, 0.5, 0.505, 1.0)])
    got = {(r.g, r.p): r.value for r in order_statistics(table, ["g"], pick).collect()}
    for g in "ab":
        values = sorted(v for k, v in rows if k == g and v is not None)
        assert [got[g, p] for p in (0.25, 0.5, 0.505, 1.0)] == [values[math.floor(len(values) * p) - 1] for p in (0.25, 0.5, 0.505, 1.0)]
