"""Activity counters and keyed merges over event tables.

The reference keeps counters and an event log in a document store; here the
event log is a table (batch or stream) and every counter is an aggregate over
it, so counts stay exact however the log is partitioned.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import COUNTER_KEYS
from .ordered import floored_running_sum


def event_counts(events: DataFrame, action: str = "action", keys: list[str] | None = None) -> DataFrame:
    """``(key, value)`` events per action; known keys that never occur → 0."""
    counts = events.groupBy(F.col(action).alias("key")).agg(F.count(F.lit(1)).alias("value"))
    known = keys if keys is not None else COUNTER_KEYS
    if not known:
        return counts
    spark = events.sparkSession
    ks = spark.createDataFrame([(k,) for k in known], "key string")
    # full outer: known keys get 0, keys outside the list are kept
    return (ks.join(counts, "key", "full")
            .select("key", F.coalesce(F.col("value"), F.lit(0)).cast("bigint").alias("value")))


def counter_value(events: DataFrame, key: str, action: str = "action") -> DataFrame:
    """E5: current value of one counter, 0 when absent (one row)."""
    return events.where(F.col(action) == F.lit(key)).agg(F.count(F.lit(1)).cast("bigint").alias("value"))


def session_deltas(events: DataFrame, kind: str, start: str, end: str) -> DataFrame:
    """+1 for a session start, -1 for an end, 0 otherwise (as ``delta``)."""
    return events.withColumn("delta", F.when(F.col(kind) == start, 1.0)
                             .when(F.col(kind) == end, -1.0).otherwise(0.0))


def active_sessions(events: DataFrame, order: list[str], kind: str, start: str, end: str,
                    partition: list[str] | None = None) -> DataFrame:
    """Running count of open sessions that never goes below zero
    (an end with nothing open is ignored), per ``partition`` key or global.
    Adds ``running`` (plain sum) and ``active``."""
    d = session_deltas(events, kind, start, end)
    return floored_running_sum(d, order, "delta", 0.0, partition, out="active")


def merge_max(target: DataFrame, source: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Insert keys missing from ``target``; raise present ones to the larger value."""
    t = target.select(F.col(key).alias("key"), F.col(value).alias("_t"))
    s = source.select(F.col(key).alias("key"), F.col(value).alias("_s"))
    return t.join(s, "key", "full").select(
        "key", F.greatest(F.coalesce("_t", "_s"), F.coalesce("_s", "_t")).alias("value"))


def merge_fill(target: DataFrame, source: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Keys compared trimmed and lower-cased; insert when absent, fill a
    present key only when its value is empty, never overwrite. Keys of one side
    that become equal give one row: the first non-empty value in the order of
    the raw keys (then values) stands for them."""
    def one_per_key(df, out):
        empty = F.coalesce(F.trim(F.col(value)), F.lit("")) == ""
        return df.groupBy(F.lower(F.trim(F.col(key))).alias("key")).agg(
            F.min(F.struct(empty.alias("empty"), F.col(key).alias("raw"), F.col(value).alias("value")))["value"].alias(out))

    t = one_per_key(target, "_t").withColumn("_in_t", F.lit(True))
    s = one_per_key(source, "_s")
    empty = F.coalesce(F.trim(F.col("_t")), F.lit("")) == ""
    src_ok = F.coalesce(F.trim(F.col("_s")), F.lit("")) != ""
    val = (F.when(F.col("_in_t").isNull(), F.col("_s"))
           .when(empty & src_ok, F.col("_s")).otherwise(F.col("_t")))
    return t.join(s, "key", "full").select("key", val.alias("value"))


def decrement(value, floor: int = 0):
    """E2 single-step decrement with a floor: ``max(v - 1, floor)``."""
    return F.greatest(F.col(value) - 1, F.lit(floor)) if isinstance(value, str) else F.greatest(value - 1, F.lit(floor))


def append_events(events: DataFrame, path: str, ts: str | None = None) -> None:
    """Append events to the log table, stamping missing times with the UTC now."""
    out = events if ts is None else events.withColumn(ts, F.coalesce(F.col(ts), F.current_timestamp()))
    out.write.mode("append").parquet(path)
