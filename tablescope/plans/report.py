"""The export report as five tables written side by side.

Data, Executive Summary (10 metrics), Column Details (13 columns),
Correlation Matrix and Insights; each is a DataFrame written with the
regular writers (parquet by default) under ``path/<table>``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY_METRICS = [
    ("Total Rows", "total_rows"), ("Total Columns", "total_columns"), ("Missing Values", "missing_values"),
    ("Missing Values %", "missing_percentage"), ("Duplicate Rows", "duplicate_rows"),
    ("Memory Usage (MB)", "estimated_mb"), ("Numeric Columns", "numeric_columns_count"),
    ("Categorical Columns", "categorical_columns_count"), ("Date Columns", "date_columns_count"),
    ("Analysis Time (ms)", None),
]
DETAIL_COLUMNS = [("Column", "column_name"), ("Type", "detected_type"), ("Null Count", "null_count"),
                  ("Null %", "null_percentage"), ("Unique Values", "unique_count"), ("Min", "min"),
                  ("Max", "max"), ("Mean", "mean"), ("Median", "median"), ("Mode", "mode"),
                  ("Std Dev", "std_dev"), ("IQR", "iqr"), ("Outliers", "outliers_count")]


def report_summary(summary: DataFrame, elapsed_ms: float | None = None) -> DataFrame:
    """Executive Summary: ``(ord, metric, value)``, ten rows."""
    rows = []
    for i, (label, col) in enumerate(SUMMARY_METRICS):
        val = F.col(col).cast("double") if col else F.lit(elapsed_ms).cast("double")
        rows.append(F.struct(F.lit(i).alias("ord"), F.lit(label).alias("metric"), val.alias("value")))
    return summary.select(F.inline(F.array(*rows)))


def report_columns(columns: DataFrame) -> DataFrame:
    """Column Details: thirteen columns; statistics NULL for non-numeric columns
    (so the outlier count is a DOUBLE, like the other statistics)."""
    out = []
    for name, src in DETAIL_COLUMNS:
        c = F.col(src) if src in columns.columns else F.lit(None)
        out.append((c.cast("double") if src == "outliers_count" else c).alias(name))
    return columns.select(*out)


def report_matrix(corr_long: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation Matrix: one row per column, one column per column (pivot)."""
    return (corr_long.groupBy("col_x", "pos_x").pivot("col_y", list(columns)).agg(F.first("r"))
            .withColumnRenamed("col_x", "column_name").drop("pos_x"))


def report_insights(ins: DataFrame) -> DataFrame:
    return ins.select(F.col("type").alias("Type"), F.col("severity").alias("Severity"),
                      F.col("title").alias("Title"), F.col("description").alias("Description"))


def write_report(result: dict, data: DataFrame, path: str, fmt: str = "parquet") -> dict:
    """Write the five tables of an ``analyze`` result under ``path``."""
    tables = {"data": data, "executive_summary": report_summary(result["summary"]),
              "column_details": report_columns(result["columns"]),
              "insights": report_insights(result["insights"])}
    if result.get("correlation") is not None:
        num = [t["column_name"] for t in result["type_rows"] if t["is_numeric"] and not t["is_id"]]
        tables["correlation_matrix"] = report_matrix(result["correlation"], num)
    out = {}
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(target)
        out[name] = target
    return out
