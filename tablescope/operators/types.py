"""Semantic type inference (one row per column), from the frequency table.

Rules, first that fires wins: no values → Text; ≥ 80 % numbers → Percentage /
Currency / Integer / Float; physical timestamp or ≥ 80 % dates → Date /
Datetime; ≥ 80 % boolean tokens → Boolean; id-like name → Unique IDs;
> 80 % e-mail / image URL / file URL / URL / phone → that label; ≤ 100
distinct → Category, else Text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (BOOLEAN_TOKENS, CATEGORY_MAX_DISTINCT, CURRENCY_CHAR_PATTERN,
                                   CURRENCY_NAME_KEYWORDS, EMAIL_PATTERN, FILE_URL_PATTERN,
                                   ID_KEYWORDS, IMAGE_URL_PATTERN, NAME_TOKEN_SPLIT, PHONE_PATTERN,
                                   SUBLABEL_RATIO, TYPE_RATIO, URL_PATTERN)
from .freq import frequency_table

EXCLUDED_LABELS = ["Email", "URL", "Image URL", "File URL", "Phone Number"]


def _wsum(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("cnt"))), F.lit(0)).cast("bigint")


def type_signals(freq: DataFrame) -> DataFrame:
    """Per column: counts of values passing each type test (weighted by cnt)."""
    v = F.col("value")
    nn = v.isNotNull()
    # the text tests can only fire on text-like columns: checked first, so
    # typed numbers and timestamps skip every regex
    txt = F.col("kind").isin("string", "boolean", "other") & nn
    low = F.lower(F.trim(v))
    is_ts_kind = F.col("kind") == "timestamp"
    time_any = F.when(is_ts_kind, (F.hour("ts") != 0) | (F.minute("ts") != 0) | (F.second("ts") != 0)) \
        .otherwise((F.hour("ts") != 0) | (F.minute("ts") != 0))
    return freq.groupBy("column_name", "pos", "kind").agg(
        _wsum(v.isNull()).alias("null_count"),
        _wsum(nn).alias("non_null"),
        F.count(v).alias("unique_count"),
        _wsum(F.col("num").isNotNull()).alias("num_ok"),
        _wsum(txt & v.contains("%")).alias("pct_n"),
        _wsum(txt & v.rlike(CURRENCY_CHAR_PATTERN)).alias("cur_n"),
        F.coalesce(F.min(F.when(F.col("num").isNotNull(), F.col("num") % 1 == 0)), F.lit(False))
        .alias("all_integral"),
        _wsum(F.col("ts").isNotNull()).alias("date_ok"),
        F.coalesce(F.max(F.when(F.col("ts").isNotNull(), time_any)), F.lit(False)).alias("has_time"),
        _wsum(txt & low.isin(BOOLEAN_TOKENS)).alias("bool_n"),
        _wsum(txt & v.rlike(EMAIL_PATTERN)).alias("email_n"),
        _wsum(txt & v.rlike(IMAGE_URL_PATTERN)).alias("image_n"),
        _wsum(txt & v.rlike(FILE_URL_PATTERN)).alias("file_n"),
        _wsum(txt & v.rlike(URL_PATTERN)).alias("url_n"),
        _wsum(txt & v.rlike(PHONE_PATTERN)).alias("phone_n"),
    )


def name_has_id(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return (F.exists(F.split(low, NAME_TOKEN_SPLIT), lambda t: t.isin(ID_KEYWORDS))
            | low.endswith("id") | low.startswith("id_"))


def name_has_currency(name: Column) -> Column:
    low = F.lower(F.trim(name))
    out = F.lit(False)
    for k in CURRENCY_NAME_KEYWORDS:
        out = out | low.contains(k)
    return out


def label_types(signals: DataFrame) -> DataFrame:
    """Apply the rule chain to the per-column signals."""
    nn = F.col("non_null")
    ratio = lambda c: F.try_divide(F.col(c), nn)  # noqa: E731  (NULL for an empty column)
    is_num = (nn > 0) & (ratio("num_ok") >= TYPE_RATIO)
    num_label = (F.when(ratio("pct_n") > SUBLABEL_RATIO, "Percentage")
                 .when((ratio("cur_n") > SUBLABEL_RATIO) | name_has_currency(F.col("column_name")), "Currency")
                 .when(F.col("all_integral"), "Integer")
                 .otherwise("Float"))
    is_date = ~is_num & (nn > 0) & ((F.col("kind") == "timestamp") | (ratio("date_ok") >= TYPE_RATIO))
    date_label = F.when(F.col("has_time"), "Datetime").otherwise("Date")
    is_bool = ~is_num & ~is_date & (nn > 0) & (ratio("bool_n") >= TYPE_RATIO)
    is_id = ~is_num & ~is_date & ~is_bool & (nn > 0) & name_has_id(F.col("column_name"))
    other = (F.when(ratio("email_n") > TYPE_RATIO, "Email")
             .when(ratio("image_n") > TYPE_RATIO, "Image URL")
             .when(ratio("file_n") > TYPE_RATIO, "File URL")
             .when(ratio("url_n") > TYPE_RATIO, "URL")
             .when(ratio("phone_n") > TYPE_RATIO, "Phone Number")
             .when(F.col("unique_count") <= CATEGORY_MAX_DISTINCT, "Category")
             .otherwise("Text"))
    label = (F.when(nn == 0, "Text").when(is_num, num_label).when(is_date, date_label)
             .when(is_bool, "Boolean").when(is_id, "Unique IDs").otherwise(other))
    out = signals.select(
        "column_name", "pos", "kind",
        label.alias("detected_type"),
        F.coalesce(is_id, F.lit(False)).alias("is_id"),
        F.coalesce(is_num, F.lit(False)).alias("is_numeric"),
        F.coalesce(is_date, F.lit(False)).alias("is_date"),
        ((nn > 0) & ~is_num & ~is_date).alias("is_categorical"),
        "unique_count", "null_count", "non_null",
    )
    return out.withColumn("exclude_from_charts",
                          (F.col("non_null") == 0) | F.col("detected_type").isin(EXCLUDED_LABELS))


def column_types(df: DataFrame, columns: list[str] | None = None, freq: DataFrame | None = None) -> DataFrame:
    """``(column, pos, detected_type, is_id, is_numeric, is_date, is_categorical,
    exclude_from_charts, unique_count, null_count)``; one row per column."""
    f = freq if freq is not None else frequency_table(df, columns)
    return label_types(type_signals(f)).select(
        "column_name", "pos", "detected_type", "is_id", "is_numeric", "is_date", "is_categorical",
        "exclude_from_charts", "unique_count", "null_count")


def collect_types(types_df: DataFrame) -> list[dict]:
    """Bring the per-column type table to the driver (one row per column)."""
    rows = types_df.orderBy("pos").collect()
    return [r.asDict() for r in rows]
