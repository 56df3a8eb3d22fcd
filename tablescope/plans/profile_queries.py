"""Registered queries A1-A19 and T1-T9 (profile and types) with DuckDB twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.corr import correlation
from ..operators.freq import cells_table, frequency_table
from ..operators.profile import (dataset_summary, date_ranges, duplicate_rows, modes, monthly_distribution,
                                 null_and_distinct, numeric_moments, numeric_stats, outlier_counts,
                                 quantiles, table_histogram, top_values)
from ..operators.types import collect_types, column_types
from .tables import load, with_nulls

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]


def numeric_columns_of(df, freq=None):
    """Numeric, non-id columns according to the inferred types (driver gets one row per column)."""
    types = collect_types(column_types(df, freq=freq))
    return [t["column_name"] for t in types if t["is_numeric"] and not t["is_id"]]


def lineitem_nulls(spark, sf):
    """lineitem with derived missing values (the driver's tables have none)."""
    li = load(spark, sf, "lineitem")
    return with_nulls(li, {"l_discount": F.col("l_linenumber") == 1,
                           "l_tax": F.col("l_linenumber") == 2,
                           "l_returnflag": F.col("l_linenumber") <= 3})


LINEITEM_NULLS_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS l_tax,
  CASE WHEN l_linenumber <= 3 THEN NULL ELSE l_returnflag END AS l_returnflag,
  l_linestatus, l_shipdate FROM lineitem)"""


# ---------------------------------------------------------------- Spark side
def q_dataset_summary(spark, sf):
    df = load(spark, sf, "orders")
    freq = frequency_table(df, persist=True)
    return dataset_summary(df, column_types(df, freq=freq), freq).drop("estimated_mb")


def q_dataset_summary_nulls(spark, sf):
    df = lineitem_nulls(spark, sf)
    freq = frequency_table(df, persist=True)
    return dataset_summary(df, column_types(df, freq=freq), freq).drop("estimated_mb")


def q_duplicate_rows(spark, sf):
    """A3 over whole rows: orders with every tenth row again, twice for every thirtieth, and a null in some of them."""
    o = load(spark, sf, "orders")
    o = o.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 20 != 0, F.col("o_orderpriority")))
    df = o.unionByName(o.where(F.col("o_orderkey") % 10 == 0)).unionByName(o.where(F.col("o_orderkey") % 30 == 0))
    return duplicate_rows(df)


def q_estimated_bytes(spark, sf):
    df = load(spark, sf, "orders")
    freq = frequency_table(df, persist=True)
    return dataset_summary(df, column_types(df, freq=freq), freq).select("estimated_mb")


def q_null_and_distinct(spark, sf):
    return null_and_distinct(frequency_table(lineitem_nulls(spark, sf))).drop("pos")


def q_numeric_stats(spark, sf):
    df = load(spark, sf, "lineitem")
    return numeric_moments(df, numeric_columns_of(df, frequency_table(df, persist=True))).drop("n")


def q_quantiles(spark, sf):
    df = load(spark, sf, "lineitem")
    freq = frequency_table(df, persist=True)
    cols = numeric_columns_of(df, freq)
    st = numeric_stats(df, cols, freq)
    return st.select("column_name", "q1", "median", "q3", "iqr")


def q_quantiles_nulls(spark, sf):
    df = lineitem_nulls(spark, sf)
    freq = frequency_table(df, ["l_discount", "l_tax", "l_quantity"])
    q = quantiles(freq, ["l_discount", "l_tax", "l_quantity"], ps=(0.1, 0.25, 0.5, 0.9))
    from ..functions import safe
    return q.select("column_name", "p", safe("value", 4).alias("value"))


def q_mode(spark, sf):
    df = load(spark, sf, "lineitem")
    return modes(frequency_table(df, LINEITEM_NUM), LINEITEM_NUM)


def q_outliers(spark, sf):
    df = load(spark, sf, "lineitem")
    freq = frequency_table(df, LINEITEM_NUM, persist=True)
    return outlier_counts(freq, LINEITEM_NUM, quantiles(freq, LINEITEM_NUM))


def q_skew_kurt(spark, sf):
    df = load(spark, sf, "lineitem")
    return numeric_moments(df, LINEITEM_NUM).select("column_name", "skewness", "kurtosis")


def q_top_values(spark, sf):
    return top_values(frequency_table(load(spark, sf, "orders"))).drop("pos")


def q_bottom_values(spark, sf):
    return top_values(frequency_table(load(spark, sf, "orders")), ascending=True).drop("pos")


def q_histogram(spark, sf):
    df = load(spark, sf, "lineitem")
    return table_histogram(df, LINEITEM_NUM)


def q_histogram_constant(spark, sf):
    df = load(spark, sf, "orders").select(F.lit(7.0).alias("k"), F.col("o_totalprice"))
    return table_histogram(df, ["k", "o_totalprice"])


def q_monthly_distribution(spark, sf):
    df = load(spark, sf, "orders")
    return monthly_distribution(cells_table(df, ["o_orderdate"]), ["o_orderdate"])


def q_date_range(spark, sf):
    o = date_ranges(cells_table(load(spark, sf, "orders"), ["o_orderdate"]), ["o_orderdate"])
    e = date_ranges(cells_table(load(spark, sf, "events"), ["ts"]), ["ts"])
    return o.unionByName(e)


def q_correlation(spark, sf):
    df = load(spark, sf, "lineitem")
    return correlation(df, numeric_columns_of(df, frequency_table(df, persist=True)))


def q_correlation_with_nulls(spark, sf):
    df = lineitem_nulls(spark, sf)
    return correlation(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def q_correlation_constant(spark, sf):
    df = load(spark, sf, "orders").select(F.lit(1.5).alias("k"), "o_totalprice", "o_custkey")
    return correlation(df, ["k", "o_totalprice", "o_custkey"])


def q_correlation_outlier_null(spark, sf):
    """A huge value of one column beside a missing one of the other, and an offset that dwarfs the spread."""
    li = load(spark, sf, "lineitem")
    beside = F.col("l_linenumber") == 1
    df = li.select(F.when(beside, F.lit(-1e9)).otherwise(F.col("l_quantity")).alias("quantity"),
                   F.when(~beside, F.col("l_extendedprice")).alias("price"),
                   (F.col("l_extendedprice") + 1e9).alias("far"), F.lit(0.1).alias("same"))
    return correlation(df, ["quantity", "price", "far", "same"])


def q_column_types(spark, sf):
    return column_types(load(spark, sf, "orders")).drop("pos")


def q_column_types_lineitem(spark, sf):
    return column_types(load(spark, sf, "lineitem")).drop("pos")


def q_column_types_url(spark, sf):
    return column_types(load(spark, sf, "pages")).drop("pos")


def q_column_types_zoo(spark, sf):
    """Padded dates longer than any layout, image and file links, phone numbers, an empty column."""
    n = F.col("o_orderkey").cast("string")
    df = load(spark, sf, "orders").select(
        F.concat(F.lit(" " * 35), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("padded_day"),
        F.concat(F.lit("https://img.example.com/"), n, F.lit(".png")).alias("picture"),
        F.concat(F.lit("https://files.example.com/"), n, F.lit(".pdf")).alias("paper"),
        F.concat(F.lit("+1 555 010 "), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")).alias("call"),
        F.lit(None).cast("string").alias("nothing"))
    return column_types(df).drop("pos")


def q_column_types_text(spark, sf):
    """Numbers, dates and booleans written as text, derived from orders."""
    o = load(spark, sf, "orders")
    df = o.select(
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("amount_text"),
        F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%")).alias("share"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("when_text"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("flag"),
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("order_no"),
        F.concat(F.lit("user"), (F.col("o_custkey") % 50).cast("string"), F.lit("@mail.example.com")).alias("contact"),
        F.col("o_orderpriority"),
    )
    return column_types(df).drop("pos")


def q_column_profile(spark, sf):
    """Flagship: one row per column with type, counts and numeric statistics."""
    df = load(spark, sf, "lineitem")
    freq = frequency_table(df, persist=True)
    types = column_types(df, freq=freq)
    rows = collect_types(types)
    cols = [t["column_name"] for t in rows if t["is_numeric"] and not t["is_id"]]
    stats = numeric_stats(df, cols, freq)
    nd = null_and_distinct(freq).drop("unique_count", "null_count")
    return (types.join(nd, ["column_name", "pos"]).join(stats, "column_name", "left").drop("pos"))


SPARK = {
    "dataset_summary": q_dataset_summary,
    "dataset_summary_nulls": q_dataset_summary_nulls,
    "duplicate_rows": q_duplicate_rows,
    "estimated_bytes": q_estimated_bytes,
    "null_and_distinct": q_null_and_distinct,
    "numeric_stats": q_numeric_stats,
    "quantiles": q_quantiles,
    "quantiles_nulls": q_quantiles_nulls,
    "mode": q_mode,
    "outliers": q_outliers,
    "skew_kurt": q_skew_kurt,
    "top_values": q_top_values,
    "bottom_values": q_bottom_values,
    "histogram": q_histogram,
    "histogram_constant": q_histogram_constant,
    "monthly_distribution": q_monthly_distribution,
    "date_range": q_date_range,
    "correlation": q_correlation,
    "correlation_with_nulls": q_correlation_with_nulls,
    "correlation_constant": q_correlation_constant,
    "correlation_outlier_null": q_correlation_outlier_null,
    "column_types": q_column_types,
    "column_types_lineitem": q_column_types_lineitem,
    "column_types_url": q_column_types_url,
    "column_types_text": q_column_types_text,
    "column_types_zoo": q_column_types_zoo,
    "column_profile": q_column_profile,
}


def _lineitem_analysis(spark, sf):
    from .analyze import analyze
    return analyze(load(spark, sf, "lineitem"), order=["l_orderkey", "l_linenumber"])


def q_report_summary(spark, sf):
    """S10 Executive Summary of lineitem (the timing row is NULL)."""
    from .report import report_summary
    return report_summary(_lineitem_analysis(spark, sf)["summary"])


def q_report_columns(spark, sf):
    """S10 Column Details of lineitem."""
    from .report import report_columns
    return report_columns(_lineitem_analysis(spark, sf)["columns"])


def q_report_matrix(spark, sf):
    """S10 Correlation Matrix of lineitem (pivoted)."""
    from .report import report_matrix
    return report_matrix(correlation(load(spark, sf, "lineitem"), LINEITEM_NUM), LINEITEM_NUM)


SPARK.update({"report_summary": q_report_summary, "report_columns": q_report_columns,
              "report_matrix": q_report_matrix})


def q_column_types_embeddings(spark, sf):
    """An ARRAY<FLOAT> column is profiled through its JSON text."""
    return column_types(load(spark, sf, "embeddings")).drop("pos")


def q_quantiles_approx(spark, sf):
    """Opt-in approximate quartiles of lineitem's numeric columns (no exact twin)."""
    from .tables import load as _load
    from ..operators.profile import approx_quantiles
    from ..functions import safe
    df = _load(spark, sf, "lineitem")
    return approx_quantiles(df, LINEITEM_NUM).select("column_name", "p", safe("value", 4).alias("value"))


SPARK.update({"column_types_embeddings": q_column_types_embeddings, "quantiles_approx": q_quantiles_approx})
