import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.operators.corr import correlation
from tablescope.operators.freq import frequency_table
from tablescope.operators.profile import (histogram, modes, numeric_moments, outlier_counts, quantiles,
                                          top_values, dataset_summary)
from tablescope.operators.types import column_types


def _edges_frame(spark):
    rows = []
    groups = {"n1": [5.0], "n2": [1.0, 4.0], "n3": [1.0, 2.0, 10.0], "n4": [3.0, 1.0, 4.0, 1.0],
              "const": [7.0] * 6, "nulls": [1.0, None, 3.0, None, 8.0, 2.0],
              "ties": [2.0, 2.0, 1.0, 1.0, 9.0, 5.5, 5.5]}
    width = max(len(v) for v in groups.values())
    for i in range(width):
        rows.append(tuple(v[i] if i < len(v) else None for v in groups.values()))
    return spark.createDataFrame(rows, ", ".join(f"{k} double" for k in groups)), groups


@pytest.mark.parametrize("from_freq", [False, True])
def test_moments_match_pandas(spark, from_freq):
    df, groups = _edges_frame(spark)
    freq = frequency_table(df) if from_freq else None
    got = {r["column_name"]: r for r in numeric_moments(df, list(groups), freq).collect()}
    for name, vals in groups.items():
        s = pd.Series([v for v in vals if v is not None])
        r = got[name]
        assert r["min"] == s.min() and r["max"] == s.max()
        assert r["mean"] == float(np.round(s.mean(), 4))
        assert r["variance"] == (float(np.round(s.var(), 4)) if len(s) > 1 else 0.0)
        exp_skew = float(np.round(s.skew(), 4)) if len(s) > 2 else 0.0
        exp_kurt = float(np.round(s.kurtosis(), 4)) if len(s) > 3 else 0.0
        assert r["skewness"] == pytest.approx(0.0 if math.isnan(exp_skew) else exp_skew, abs=1e-4)
        assert r["kurtosis"] == pytest.approx(0.0 if math.isnan(exp_kurt) else exp_kurt, abs=1e-4)


def test_quantiles_mode_outliers_match_pandas(spark):
    df, groups = _edges_frame(spark)
    cols = list(groups)
    f = frequency_table(df, cols)
    q = quantiles(f, cols, ps=(0.1, 0.25, 0.5, 0.75, 0.9))
    got = {(r[0], r[1]): r[2] for r in q.collect()}
    md = {r[0]: r[1] for r in modes(f, cols).collect()}
    oc = {r[0]: r[1] for r in outlier_counts(f, cols, quantiles(f, cols)).collect()}
    for name, vals in groups.items():
        s = pd.Series([v for v in vals if v is not None])
        for p in (0.1, 0.25, 0.5, 0.75, 0.9):
            assert got[(name, p)] == pytest.approx(s.quantile(p), abs=1e-9)
        assert md[name] == s.mode().iloc[0]
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        assert oc[name] == int(((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum())


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(50, 10, 500), [0.0, 100.0, 100.0]])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    h = histogram(frequency_table(df), ["x"]).orderBy("bin").collect()
    bins = min(10, max(3, int(np.sqrt(len(vals)))))
    counts, edges = np.histogram(vals, bins=bins)
    assert [r["count"] for r in h] == counts.tolist()
    assert h[0]["label"] == f"{float(np.round(edges[0], 2))} - {float(np.round(edges[1], 2))}"


def test_table_histogram_equals_that_of_the_frequency_table(spark):
    from tablescope.operators.profile import table_histogram
    rng = np.random.default_rng(2)
    rows = [(float(v), int(v) % 5, None, f"{v:.1f}" if v > 40 else "n/a") for v in rng.normal(50, 10, 400)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "x double, k int, none double, t string")
    columns = ["x", "k", "none", "t"]
    key = lambda r: (r["column_name"], r["bin"])
    want = sorted(histogram(frequency_table(df, columns), columns).collect(), key=key)
    assert sorted(table_histogram(df, columns).collect(), key=key) == want and len(want) == 30
    assert table_histogram(df, ["none"]).count() == 0


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(3.0,)] * 9, "x double")
    h = histogram(frequency_table(df), ["x"]).orderBy("bin").collect()
    counts, edges = np.histogram(np.array([3.0] * 9), bins=3)
    assert [r["count"] for r in h] == counts.tolist()


def test_correlation_pairwise_and_constant(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, None, 4.0, 5.0, 7.0], "b": [2.0, None, 3.0, 8.0, 9.0, 13.0],
                        "c": [1.0] * 6})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double")
    got = {(r["col_x"], r["col_y"]): r["r"] for r in correlation(df, ["a", "b", "c"]).collect()}
    exp = pdf.corr().fillna(0).round(4)
    for x in "abc":
        for y in "abc":
            assert got[(x, y)] == pytest.approx(float(exp.loc[x, y]), abs=1e-4)


def test_correlation_with_an_outlier_beside_a_null(spark):
    """The huge value is in no complete row of the pair, so it changes nothing."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 2000)
    y = x + rng.normal(0, 0.5, 2000)
    rows = [(float(a), float(b), 0.1, float(a) + 1e12) for a, b in zip(x, y)] + [(-1e9, None, 0.1, None), (None, 1e15, 0.1, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    got = {(r["col_x"], r["col_y"]): r["r"] for r in correlation(df, list("abcd")).collect()}
    assert got[("a", "b")] == got[("b", "a")] == round(float(np.corrcoef(x, y)[0, 1]), 4)
    assert got[("a", "a")] == got[("b", "b")] == 1.0
    assert got[("a", "d")] == pytest.approx(1.0, abs=1e-4)
    assert all(got[("c", o)] == 0.0 for o in "abcd")


def test_comoments_merge_like_one_batch():
    from tablescope.operators.corr import batch_state, merge_states
    rng = np.random.default_rng(4)
    x = rng.normal(1e6, 3, (999, 5))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 0.1
    merged = np.zeros((6, 5, 5))
    for part in np.array_split(x, 17):
        merged = merge_states(merged, batch_state(part))
    assert np.allclose(merged, batch_state(x), rtol=1e-9)
    assert (merged[4][:, 4] == 0).all() and (merged[5][:, 4] == 0).all()
    pairs = pd.DataFrame(x).corr()
    assert merged[5][0, 1] / np.sqrt(merged[3][0, 1] * merged[4][0, 1]) == pytest.approx(pairs.iloc[0, 1], abs=1e-9)


def test_moments_of_a_constant_fraction(spark):
    df = spark.createDataFrame([(0.1,)] * 7, "x double")
    r = numeric_moments(df, ["x"], frequency_table(df)).first()
    assert (r["mean"], r["variance"], r["skewness"], r["kurtosis"]) == (0.1, 0.0, 0.0, 0.0)


def test_top_values_and_summary(spark):
    rows = [("a", 1), ("a", 1), ("b", 2), (None, 3), ("c", None), ("a", 1)]
    df = spark.createDataFrame(rows, "k string, v int")
    f = frequency_table(df)
    top = top_values(f, ["k"]).orderBy("rank").collect()
    assert [(r["value"], r["count"], r["percentage"]) for r in top] == [("a", 3, 60.0), ("b", 1, 20.0), ("c", 1, 20.0)]
    s = dataset_summary(df, column_types(df, freq=f), f).first()
    assert s["total_rows"] == 6 and s["missing_values"] == 2 and s["duplicate_rows"] == 2
    assert s["missing_percentage"] == round(2 / 12 * 100, 2)


def test_approx_mode_close_to_exact(spark):
    from tablescope.operators.profile import approx_distinct, approx_quantiles
    rng = np.random.default_rng(11)
    vals = rng.normal(100, 15, 5000)
    df = spark.createDataFrame([(float(v), int(v) % 97) for v in vals], "x double, k long")
    got = {r["p"]: r["value"] for r in approx_quantiles(df, ["x"], ps=(0.25, 0.5, 0.75)).collect()}
    for p, v in got.items():
        assert abs(v - np.quantile(vals, p)) < 1.0
    d = {r["column_name"]: r["unique_count"] for r in approx_distinct(df, ["x", "k"]).collect()}
    assert abs(d["x"] - 5000) < 250 and abs(d["k"] - len({int(v) % 97 for v in vals})) <= 3


def test_duplicate_rows_by_digest(spark, monkeypatch):
    from tablescope.operators import profile
    rows = [("a", None, 1.0), ("a", None, 1.0), (None, "a", 1.0), ("a", "", 1.0), ("", "a", 1.0), (None, None, None), (None, None, None),
            ("x", "y", -0.0), ("x", "y", 0.0), ("n", "n", float("nan")), ("n", "n", float("nan"))]
    df = spark.createDataFrame(rows, "a string, b string, `c d` double")
    want = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).count().agg(F.sum(F.col("count") - 1)).first()[0]
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == want == 4
    plan = profile.duplicate_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "_d1" in plan
    # digests that collide: the rows are told apart by their cells
    monkeypatch.setattr(profile, "row_digests", lambda d: [F.lit(0), F.lit(0), F.xxhash64(*[F.col(f"`{c}`") for c in d.columns])])
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == want
    assert profile.duplicate_rows(df.limit(0)).first()["duplicate_rows"] == 0
