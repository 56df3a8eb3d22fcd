"""The main lifecycle as one call: filter → sort → profile → charts → insights → page.

``analyze(df, spec)`` returns a dict of lazy DataFrames (plus the collected
type rows, one per column). Only schema-sized results reach the driver: the
column types and what was observed of each column on the way (for the warnings).
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import charts as ch
from ..operators.clean import ORDER_COLS
from ..operators.corr import correlation, correlation_matrix
from ..operators.filters import FilterSpec, apply_filters
from ..operators.freq import frequency_table
from ..operators.insights import insights
from ..operators.paging import page, page_info, sort_orders
from ..operators.profile import (FIVE_POINTS, column_counts, dataset_summary, date_ranges, histogram,
                                 monthly_distribution, null_and_distinct, numeric_stats, quantiles, top_values)
from ..operators.types import collect_types, column_types
from ..functions.constants import COLUMN_WARNING

#: A histogram or a boxplot needs so many values.
LEAST_VALUES = 3


def _observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The table with its rows and every column's infinite values counted while it is read."""
    seen = Observation(f"profile-{uuid.uuid4().hex[:8]}")
    infinite = [F.count_if(F.abs(F.col(f"`{f.name}`")) == float("inf")).alias(f"inf{i}") for i, f in enumerate(df.schema.fields)
                if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *infinite), seen


def profile_warnings(df: DataFrame, seen: dict, types: list[dict]) -> list[str]:
    """Columns that are profiled in part only, and charts that are left out for lack of values."""
    out = []
    for i, f in enumerate(df.schema.fields):
        if seen.get(f"inf{i}"):
            out.append(COLUMN_WARNING.format(x=f.name, reason=f"{seen[f'inf{i}']} infinite values"))
        elif isinstance(f.dataType, (T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            out.append(COLUMN_WARNING.format(x=f.name, reason=f"type {f.dataType.simpleString()} is profiled as text"))
    for t in types:
        values = seen["rows"] - t["null_count"]
        if t["is_numeric"] and not t["exclude_from_charts"] and values < LEAST_VALUES:
            out += [f"{chart} of {t['column_name']} skipped: {values} values" for chart in ("Histogram", "Boxplot")]
    return out


def analyze(df: DataFrame, spec: FilterSpec | dict | None = None, order: list[str] | None = None,
            warnings: list | None = None) -> dict:
    """Profile the filtered table and return every result table.

    ``order`` names the columns that define row order (the reference's file
    order); it breaks ties in sorting and picks the first rows for scatter
    charts. A table cleaned with its order kept (``clean_table(..., keep_order=True)``)
    brings that order along in columns that are not profiled. Export ignores the sort, as the reference does; pass the sorted
    ``rows`` yourself if you want it.
    """
    if isinstance(spec, dict):
        spec = FilterSpec(**{k: v for k, v in spec.items() if k in FilterSpec.__dataclass_fields__})
    spec = spec or FilterSpec()
    warnings = [] if warnings is None else warnings
    carried = [c for c in ORDER_COLS if c in df.columns]
    order = order or carried
    ordered = apply_filters(df, spec, warnings=warnings)
    filtered = ordered.drop(*carried)
    observed, seen = _observed(filtered)
    freq = frequency_table(observed, persist=True)
    types_df = column_types(filtered, freq=freq)
    types = collect_types(types_df)
    warnings += profile_warnings(filtered, seen.get, types)
    num = [t["column_name"] for t in types if t["is_numeric"] and not t["is_id"]]
    cat = [t["column_name"] for t in types if t["is_categorical"] or t["detected_type"] in
           ("Category", "Boolean", "Text", "Unique IDs")]
    dat = [t["column_name"] for t in types if t["is_date"]]
    summary = dataset_summary(filtered, types_df, freq)
    # found once, for the statistics and the boxplots
    five = quantiles(freq, num, FIVE_POINTS) if num else None
    stats = numeric_stats(filtered, num, freq, five) if num else None
    nd = null_and_distinct(freq).join(column_counts(freq).select("column_name", "total_rows"), "column_name")
    per_column = nd.join(stats, "column_name", "left") if stats is not None else \
        nd.withColumn("outliers_count", F.lit(None).cast("bigint"))
    corr = correlation(filtered, num) if len(num) >= 2 else None
    top = top_values(freq, cat)
    sorted_orders = sort_orders(ordered, spec.sort_by, spec.sort_direction, order)
    okeys = [F.col(f"`{c}`") for c in order] or [F.col(f"`{filtered.columns[0]}`")]
    return {
        "types": types_df,
        "type_rows": types,
        "summary": summary,
        "columns": types_df.join(per_column.drop("pos", "null_count", "unique_count"), "column_name"),
        "top_values": top,
        "bottom_values": top_values(freq, cat, ascending=True),
        "histograms": histogram(freq, num) if num else None,
        "date_ranges": date_ranges(freq, dat) if dat else None,
        "monthly": monthly_distribution(freq, dat) if dat else None,
        "correlation": corr,
        "correlation_matrix": correlation_matrix(corr, num) if corr is not None else None,
        "numeric_top_values": top_values(freq, num) if num else None,
        "numeric_bottom_values": top_values(freq, num, ascending=True) if num else None,
        "charts": ch.chart_points(ordered, types, okeys, corr, freq, five),
        "insights": insights(summary, per_column, corr, top_values(freq, cat, k=1)),
        "rows": page(ordered, spec.page, spec.page_size, sorted_orders or (okeys if order else None)).drop(*carried),
        "warnings": df.sparkSession.createDataFrame([(w,) for w in warnings], "warning string"),
        "page": page_info(filtered, spec.page, spec.page_size),
    }
