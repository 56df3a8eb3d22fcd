"""Resampled sums over a date × numeric pair, with gap filling.

The bin width is chosen per pair from the span of rows where both values are
present (> 90 days month, > 14 days week ending Sunday, else day); empty bins
come from a calendar spine left-joined to the sums, as pandas' ``resample``
emits 0 for them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_number, as_timestamp, safe
from ..functions.dates import monday_week_number, week_end_sunday
from .reshape import unpivot_structs


def _bin_end(ts, gran):
    d = F.to_date(ts)
    return (F.when(gran == "month", F.last_day(d))
            .when(gran == "week", week_end_sunday(d))
            .otherwise(d))


def _label(day, gran):
    week = F.concat(F.date_format(day, "yyyy"), F.lit("-"),
                    F.lpad(monday_week_number(day).cast("string"), 2, "0"))
    return (F.when(gran == "month", F.date_format(day, "yyyy-MM"))
            .when(gran == "week", week)
            .otherwise(F.date_format(day, "yyyy-MM-dd")))


def resample_sums(df: DataFrame, pairs: list[tuple[str, str]], digits: int | None = 4,
                  granularity: str | None = None) -> DataFrame:
    """``(date_column, measure, granularity, period, label, value, running_value)``.

    ``granularity`` (day, week or month) overrides the choice by the span.

    ``period`` is the bin's end date; ``running_value`` the cumulative sum
    (a window per pair over its few periods).
    """
    structs = []
    for d, m in pairs:
        structs.append(F.struct(F.lit(d).alias("date_column"), F.lit(m).alias("measure"),
                                as_timestamp(F.col(f"`{d}`"), df.schema[d].dataType).alias("ts"),
                                as_number(F.col(f"`{m}`"), df.schema[m].dataType).alias("v")))
    rows = unpivot_structs(df, structs).where(F.col("ts").isNotNull() & F.col("v").isNotNull())
    keys = ["date_column", "measure"]
    span = rows.groupBy(*keys).agg(F.min("ts").alias("mn"), F.max("ts").alias("mx"))
    days = F.floor((F.unix_micros("mx") - F.unix_micros("mn")) / F.lit(86_400_000_000))
    gran = F.lit(granularity) if granularity else F.when(days > 90, "month").when(days > 14, "week").otherwise("day")
    span = span.select(*keys, gran.alias("granularity"), "mn", "mx")
    # one row per pair: a bounded broadcast
    binned = rows.join(F.broadcast(span.select(*keys, "granularity")), keys)
    sums = (binned.groupBy(*keys, _bin_end(F.col("ts"), F.col("granularity")).alias("period"))
            .agg(F.sum("v").alias("value")))
    g = F.col("granularity")
    first = _bin_end(F.col("mn"), g)
    last = _bin_end(F.col("mx"), g)
    month_starts = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))
    spine = span.select(*keys, "granularity", F.explode(
        F.when(g == "month", F.transform(month_starts, lambda x: F.last_day(x)))
        .when(g == "week", F.sequence(first, last, F.expr("INTERVAL 7 DAYS")))
        .otherwise(F.sequence(first, last, F.expr("INTERVAL 1 DAY")))).alias("period"))
    filled = spine.join(sums, [*keys, "period"], "left").withColumn(
        "value", F.coalesce(F.col("value"), F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    v = (lambda c: safe(c, digits)) if digits is not None else (lambda c: F.col(c))
    return filled.select(*keys, "granularity", F.col("period").cast("timestamp").alias("period"),
                         _label(F.col("period"), g).alias("label"),
                         v("value").alias("value"),
                         (safe(F.sum("value").over(w), digits) if digits is not None
                          else F.sum("value").over(w)).alias("running_value"))
