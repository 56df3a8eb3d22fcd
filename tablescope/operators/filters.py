"""Row filters built as one Catalyst predicate, projection, facets.

``apply_filters`` turns a filter spec into a single ``where`` so Spark can
push the parts that touch raw columns down to the scan.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import as_number, as_timestamp, to_timestamp_mixed, value_text

#: Value ranges of the integral types.
INTEGRAL_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


@dataclass
class FilterSpec:
    search_query: str | None = None
    category_filters: dict = field(default_factory=dict)
    numeric_ranges: dict = field(default_factory=dict)
    date_ranges: dict = field(default_factory=dict)
    sort_by: str | None = None
    sort_direction: str = "desc"
    page: int = 1
    page_size: int = 50


def _col(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`")


def cell_text(df: DataFrame, name: str) -> Column:
    """Text of a cell as pandas prints it; missing cells print as ``nan``/``NaT``."""
    dtype = df.schema[name].dataType
    missing = "NaT" if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "nan"
    return F.coalesce(value_text(_col(df, name), dtype), F.lit(missing))


def category_predicate(df: DataFrame, spec: dict) -> Column:
    """the column's text is one of the chosen values; columns AND-ed."""
    pred = F.lit(True)
    for name, values in (spec or {}).items():
        if name in df.columns and values:
            pred = pred & value_text(_col(df, name), df.schema[name].dataType).isin([str(v) for v in values])
    return pred


def _compare(df: DataFrame, name: str, op: str, bound: Column) -> Column:
    c = _col(df, name)
    return c >= bound if op == ">=" else c <= bound


def _typed_bound(df: DataFrame, name: str, op: str, value) -> Column:
    """A bound on a typed numeric column, exact for every type and value.

    An integral column is compared with the bound rounded into the range (2.5
    becomes ``>= 3`` or ``<= 2``) and clamped to the type: a bound beyond it
    keeps all numbers or none. A decimal column is compared with the bound's
    exact decimal. Constants of the column's own type reach the scan.
    """
    dtype, c = df.schema[name].dataType, _col(df, name)
    number = float(value)
    if math.isnan(number):
        return F.lit(False)
    bits = INTEGRAL_BITS.get(type(dtype))
    if bits is not None:
        low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
        if math.isinf(number):
            bound = low - 1 if number < 0 else high + 1
        else:
            bound = value if isinstance(value, int) else (math.ceil(number) if op == ">=" else math.floor(number))
        if bound < low or bound > high:
            return c.isNotNull() if (bound < low) == (op == ">=") else F.lit(False)
        return _compare(df, name, op, F.lit(bound).cast(dtype))
    if isinstance(dtype, T.DecimalType):
        if math.isinf(number):
            return c.isNotNull() if (number < 0) == (op == ">=") else F.lit(False)
        exact = Decimal(repr(value))
        whole = dtype.precision - dtype.scale
        if abs(exact) >= Decimal(10) ** whole:
            return c.isNotNull() if (exact < 0) == (op == ">=") else F.lit(False)
        step = Decimal(1).scaleb(-dtype.scale)
        with localcontext() as places:
            places.prec = 80
            places.rounding = ROUND_CEILING if op == ">=" else ROUND_FLOOR
            exact = (exact / step).to_integral_value() * step
        if abs(exact) >= Decimal(10) ** whole:
            return c.isNotNull() if (exact < 0) == (op == ">=") else F.lit(False)
        return _compare(df, name, op, F.lit(exact).cast(dtype))
    return _compare(df, name, op, F.lit(number))


def numeric_predicate(df: DataFrame, spec: dict) -> Column:
    """inclusive bounds on the lenient number; NULL, NaN and ±Infinity fail.

    On typed numeric columns the bound is compared with the column itself so
    the comparison reaches the parquet scan (row-group skipping); the NaN and
    infinity exclusions are separate conjuncts. Text columns compare the
    parsed number.
    """
    pred = F.lit(True)
    for name, lim in (spec or {}).items():
        if name not in df.columns or not lim:
            continue
        dtype = df.schema[name].dataType
        typed = isinstance(dtype, T.NumericType)
        for key, op in (("min", ">="), ("max", "<=")):
            if lim.get(key) is None:
                continue
            if typed:
                pred = pred & _typed_bound(df, name, op, lim[key])
            else:
                num = as_number(_col(df, name), dtype)
                pred = pred & (num >= F.lit(float(lim[key])) if op == ">=" else num <= F.lit(float(lim[key])))
        if typed and isinstance(dtype, (T.FloatType, T.DoubleType)):
            c = _col(df, name)
            pred = pred & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return pred


def date_predicate(df: DataFrame, spec: dict, end_inclusive_day: bool = False) -> Column:
    """inclusive bounds; ``end`` is midnight unless ``end_inclusive_day``;
    an unparseable bound keeps no rows. The bound is a constant cast to the
    column's own timestamp type, so typed columns filter at the scan."""
    pred = F.lit(True)
    for name, lim in (spec or {}).items():
        if name not in df.columns or not lim:
            continue
        dtype = df.schema[name].dataType
        typed = isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))
        col = _col(df, name) if typed else as_timestamp(_col(df, name), dtype)
        target = dtype if typed else T.TimestampType()
        if lim.get("start"):
            pred = pred & (col >= to_timestamp_mixed(F.lit(str(lim["start"]))).cast(target))
        if lim.get("end"):
            end = to_timestamp_mixed(F.lit(str(lim["end"])))
            if end_inclusive_day:
                pred = pred & (col < F.date_add(F.to_date(end), 1).cast("timestamp").cast(target))
            else:
                pred = pred & (col <= end.cast(target))
    return pred


def validate_pattern(spark, pattern: str) -> bool:
    """Compile the pattern once with Spark's regex engine (tiny one-row job)."""
    try:
        spark.range(1).select(F.lit("x").rlike(pattern)).collect()
        return True
    except Exception:  # noqa: BLE001
        return False


def search_predicate(df: DataFrame, query: str | None, literal: bool = False,
                     warnings: list | None = None) -> Column:
    """any column's lower-cased text matches ``query`` (a regex by default)."""
    q = (query or "").strip().lower()
    if not q:
        return F.lit(True)
    texts = [F.lower(cell_text(df, c)) for c in df.columns if c not in ("_file", "_row_ord")]
    if literal:
        return F.exists(F.array(*texts), lambda x: x.contains(q))
    if not validate_pattern(df.sparkSession, q):
        if warnings is not None:
            warnings.append(f"Search pattern '{q}' is not a valid regular expression; search ignored.")
        return F.lit(True)
    return F.exists(F.array(*texts), lambda x: x.rlike(q))


def apply_filters(df: DataFrame, spec: FilterSpec | dict | None, literal_search: bool = False,
                  warnings: list | None = None) -> DataFrame:
    """category → numeric → date → search, AND-ed into one ``where``."""
    if spec is None:
        return df
    if isinstance(spec, dict):
        spec = FilterSpec(**{k: v for k, v in spec.items() if k in FilterSpec.__dataclass_fields__})
    pred = (category_predicate(df, spec.category_filters) & numeric_predicate(df, spec.numeric_ranges)
            & date_predicate(df, spec.date_ranges)
            & search_predicate(df, spec.search_query, literal_search, warnings))
    return df.where(pred)


def filter_in_values(df: DataFrame, name: str, values: list) -> DataFrame:
    """Membership in a value list of any length as a left-semi join; Spark
    broadcasts the list where its measured size allows."""
    right = df.sparkSession.createDataFrame([(v,) for v in sorted({str(v) for v in values})], "_v string")
    key = value_text(_col(df, name), df.schema[name].dataType)
    return df.join(right, key == F.col("_v"), "left_semi")


def project_columns(df: DataFrame, visible: list[str] | None) -> DataFrame:
    """keep the visible columns in table order (unknown names ignored)."""
    if not visible:
        return df
    keep = [c for c in df.columns if c in set(visible)]
    return df.select(*[_col(df, c) for c in keep])


def facets(types_rows: list[dict], top: DataFrame, stats: DataFrame, ranges: DataFrame) -> DataFrame:
    """the filter choices: first 4 categorical columns × top 8 values,
    first 4 numeric columns' min/max, first 3 date columns' range.

    ``types_rows`` is the collected type table (one row per column);
    ``top``/``stats``/``ranges`` are the A14 / A7 / A18 tables.
    """
    cat = [t["column_name"] for t in types_rows if t["is_categorical"] and t["unique_count"] > 0][:4]
    num = [t["column_name"] for t in types_rows if t["is_numeric"]]
    dat = [t["column_name"] for t in types_rows if t["is_date"]]
    cats = (top.where(F.col("column_name").isin(cat) & (F.col("rank") <= 8))
            .select(F.lit("category").alias("facet"), "column_name", F.col("rank").alias("ord"),
                    F.col("value"), F.lit(None).cast("double").alias("lo"),
                    F.lit(None).cast("double").alias("hi")))
    nums = (stats.where(F.col("column_name").isin(num[:4]))
            .select(F.lit("numeric").alias("facet"), "column_name", F.lit(0).alias("ord"),
                    F.lit(None).cast("string").alias("value"), F.col("min").alias("lo"), F.col("max").alias("hi")))
    dates = (ranges.where(F.col("column_name").isin(dat[:3]))
             .select(F.lit("date").alias("facet"), "column_name", F.lit(0).alias("ord"),
                     F.concat_ws(" .. ", "min_date", "max_date").alias("value"),
                     F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")))
    return cats.unionByName(nums).unionByName(dates)
