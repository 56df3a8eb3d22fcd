"""End-to-end lifecycle: filter → profile → charts → insights → page → report."""
import os

from tablescope.plans.analyze import analyze
from tablescope.plans.report import write_report

SF = "/root/testdata/sf0.001"


def test_analyze_orders(spark, tmp_dir):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    spec = {"category_filters": {"o_orderstatus": ["F", "O"]}, "sort_by": "o_totalprice", "page": 2, "page_size": 7}
    res = analyze(df, spec, order=["o_orderkey"])
    n = df.where("o_orderstatus in ('F', 'O')").count()
    assert res["summary"].first()["total_rows"] == n
    types = {t["column_name"]: t["detected_type"] for t in res["type_rows"]}
    assert types["o_totalprice"] == "Currency" and types["o_orderdate"] == "Date"
    assert res["columns"].count() == 6
    rows = res["rows"].orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(8, 15))
    prices = [r["o_totalprice"] for r in rows]
    assert prices == sorted(prices, reverse=True)
    info = res["page"].first()
    assert (info["page"], info["page_size"], info["total_rows"]) == (2, 7, n)
    assert res["charts"].select("type").distinct().count() >= 5
    assert res["insights"].count() >= 1
    out = write_report(res, df, os.path.join(tmp_dir, "report"))
    assert sorted(out) == ["column_details", "correlation_matrix", "data", "executive_summary", "insights"]
    assert spark.read.parquet(out["executive_summary"]).count() == 10


def test_file_order_and_warnings(spark, tmp_path):
    from tablescope.operators.clean import clean_table
    from tablescope.sources.delimited import read_delimited
    names = [f"n{(i * 7) % 40:02d}" for i in range(40)]
    (tmp_path / "t.csv").write_text("name,amount\n" + "".join(f"{n},{i}.5\n" for i, n in enumerate(names)))
    table = clean_table(read_delimited(spark, str(tmp_path / "t.csv")), keep_order=True)
    res = analyze(table, {"page": 2, "page_size": 10, "search_query": "("})
    rows = res["rows"].orderBy("position").collect()
    assert res["rows"].columns == ["name", "amount", "position"] and [r["name"] for r in rows] == names[10:20]
    assert [r["column_name"] for r in res["columns"].orderBy("column_name").collect()] == ["amount", "name"]
    assert res["warnings"].count() == 1 and res["numeric_top_values"].count() == 10


def test_quantiles_are_found_once(spark, monkeypatch):
    from tablescope.operators import charts, profile
    rows = [(i, float(i % 17), i * 0.5 if i % 3 else None, "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "row int, a double, b double, kind string")
    calls, found = [], profile.order_statistics
    monkeypatch.setattr(profile, "order_statistics", lambda *a, **k: calls.append(1) or found(*a, **k))
    res = analyze(df, order=["row"])
    assert len(calls) == 1  # twice before: for the statistics and for the boxplots
    boxes = charts.boxplot_charts(df, profile.frequency_table(df), ["row", "a", "b"])
    assert len(calls) == 2
    key = lambda t: sorted((r["series"], r["pos"], r["label"], r["y"], r["title"]) for r in t.collect())
    assert key(res["charts"].where("type = 'boxplot'")) == key(boxes) and len(key(boxes)) == 15
    stats = {r["column_name"]: r for r in profile.numeric_stats(df, ["row", "a", "b"]).collect()}
    for r in res["columns"].where("is_numeric").collect():
        assert all(r[c] == stats[r["column_name"]][c] for c in ("q1", "median", "q3", "iqr", "outliers_count"))
