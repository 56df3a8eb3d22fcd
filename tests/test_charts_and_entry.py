import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tablescope.operators.charts import custom_boxplot, custom_chart
from tablescope.operators.groups import top_n_with_others
from tablescope.operators.timeseries import resample_sums


def test_resample_matches_pandas(spark):
    for span, rule, fmt in [(5, "D", "%Y-%m-%d"), (30, "W", "%Y-%W"), (200, "ME", "%Y-%m")]:
        days = [0, 1, span // 2, span]  # gaps in between
        ts = [dt.datetime(2025, 1, 5) + dt.timedelta(days=d, hours=3) for d in days]
        vals = [1.5, 2.0, 4.0, 8.0]
        df = spark.createDataFrame(list(zip(ts, vals)), "t timestamp, v double")
        got = [(r["label"], r["value"]) for r in resample_sums(df, [("t", "v")]).orderBy("period").collect()]
        exp = pd.Series(vals, index=pd.DatetimeIndex(ts)).resample(rule).sum()
        assert got == [(i.strftime(fmt), float(v)) for i, v in exp.items()]


def test_top_n_with_others(spark):
    rows = [("g", f"l{i}", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, label string, value double")
    got = [(r["rank"], r["label"], r["value"]) for r in top_n_with_others(df, ["k"], 5).orderBy("rank").collect()]
    assert got == [(1, "l19", 19.0), (2, "l18", 18.0), (3, "l17", 17.0), (4, "l16", 16.0),
                   (5, "Others", float(sum(range(16))))]
    small = top_n_with_others(df.where(F.col("value") < 3), ["k"], 5).count()
    assert small == 3


def test_custom_charts(spark):
    rows = [(1, "b", 2.0), (2, "a", 1.234), (3, "b", None), (4, None, 5.0), (5, "c", 1.0)]
    df = spark.createDataFrame(rows, "id long, x string, y double")
    bar = [(r["label"], r["y"]) for r in custom_chart(df, "x", "y", "bar", [F.col("id")]).orderBy("pos").collect()]
    assert bar == [("b", 2.0), ("a", 1.23), ("c", 1.0)]
    pie = [(r["label"], r["y"]) for r in custom_chart(df, "x", None, "pie", [F.col("id")]).orderBy("pos").collect()]
    assert pie == [("b", 2.0), ("a", 1.0), ("Unknown", 1.0), ("c", 1.0)]
    box = [r["y"] for r in custom_boxplot(df, "y").orderBy("pos").collect()]
    nums = sorted([2.0, 1.234, 0.0, 5.0, 1.0])
    n = len(nums)
    assert box == [nums[0], nums[n // 4], nums[n // 2], nums[(3 * n) // 4], nums[-1]]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() == 11 and "detected_type" in df.columns
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 80
