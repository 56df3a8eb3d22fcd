import math
import random

import numpy as np
from pyspark.sql import functions as F

from tablescope.functions import fround, is_total_row, py_float_text, to_number, to_timestamp_mixed, clean_text


def test_to_number_fixture(spark):
    cases = {"1,234.5": 1234.5, " ₹ 5 ": 5.0, "12%": 12.0, "$1,200.50": 1200.5, "1e5": 100000.0,
             ".5": 0.5, "5.": 5.0, "-3": -3.0, "5d": None, "5f": None, "nan": None, "inf": None,
             "(5)": None, "#N/A": None, "": None, "abc": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r[0]: r[1] for r in df.select("t", to_number("t")).collect()}
    assert got == cases


def test_to_timestamp_formats(spark):
    cases = {"2025-01-05": "2025-01-05 00:00:00", "2025-01-05 10:30:00": "2025-01-05 10:30:00",
             "2025-01-05T10:30:00": "2025-01-05 10:30:00", "1/2/2025": "2025-01-02 00:00:00",
             "13/02/2025": "2025-02-13 00:00:00", "2025/03/04": "2025-03-04 00:00:00",
             "20250304": "2025-03-04 00:00:00", "Mar 4, 2025": "2025-03-04 00:00:00",
             "4 Mar 2025": "2025-03-04 00:00:00", "2025-03": "2025-03-01 00:00:00",
             "10:30": None, "today": None, "Not a date": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r[0]: (None if r[1] is None else str(r[1])) for r in
           df.select("t", to_timestamp_mixed("t")).collect()}
    assert got == cases


def test_py_float_text_matches_python_repr(spark):
    random.seed(7)
    vals = [0.0, 1.0, -2.5, 10000000.0, 1e16, 1.5e-5, 0.0001, 0.00012345, 123456789.125, 1e22, -7.25e-9,
            0.1 + 0.2, 99999999.0]
    vals += [random.uniform(-1e9, 1e9) for _ in range(200)] + [random.uniform(0, 1e-3) for _ in range(50)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for x, s in df.select("x", py_float_text("x")).collect():
        assert s == repr(x), (x, s)


def test_fround_is_numpy_round(spark):
    random.seed(3)
    vals = [round(random.uniform(-1000, 1000), random.choice([3, 4, 5])) for _ in range(2000)] + [2.675, 1.005, 0.125]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for x, r2, r4 in df.select("x", fround(F.col("x"), 2), fround(F.col("x"), 4)).collect():
        assert r2 == float(np.round(x, 2)) and r4 == float(np.round(x, 4))


def test_total_row_pattern(spark):
    rows = [("Grand Total", None, "5"), ("  ", "Subtotal", "1"), ("Sub Total", "x", "y"), ("Totally", "x", "y"),
            ("*** end", "a", "b"), ("***end", "a", "b"), ("Page 3", None, None), ("a", "b", "Notes"), ("a", "b", "c")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = [r[0] for r in df.select(is_total_row([F.col("a"), F.col("b"), F.col("c")])).collect()]
    # like Python's re: "*** end" has no word boundary after the stars, "***end" has
    assert got == [True, True, False, False, False, True, True, True, False]


def test_clean_text(spark):
    df = spark.createDataFrame([("  x \t",), ("#N/A",), ("   ",), (None,)], "t string")
    assert [r[0] for r in df.select(clean_text("t")).collect()] == ["x", None, None, None]
