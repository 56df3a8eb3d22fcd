"""Streaming forms of E1-E3 (Structured Streaming).

* ``stream_event_counts``: running count per action (complete mode); known
  keys that never occurred are filled in ``foreachBatch``, since a stream
  cannot be outer-joined with a static key list in complete mode.
* ``stream_active_sessions``: clamped session count per key with
  ``applyInPandasWithState`` over buckets of keys; events wait in the bucket's state until the watermark
  has passed and are applied in event-time order, later ones are dropped.
* ``stream_event_log``: append-only event log with a checkpoint (exactly once
  with the file sink).
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.constants import COUNTER_KEYS
from .buckets import BUCKETS, COUNTS, EVENTS, bucket, events_table, packed, released, unpacked


def stream_event_counts(events: DataFrame, out_path: str, checkpoint: str, action: str = "action",
                        keys: list[str] | None = None, available_now: bool = True):
    """E1 on a stream; each epoch rewrites ``out_path`` with ``(key, value)``."""
    known = keys if keys is not None else COUNTER_KEYS
    counts = events.groupBy(F.col(action).alias("key")).agg(F.count(F.lit(1)).alias("value"))

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        ks = spark.createDataFrame([(k,) for k in known], "key string")
        full = ks.join(batch, "key", "full").select(
            "key", F.coalesce(F.col("value"), F.lit(0)).cast("bigint").alias("value"))
        full.write.mode("overwrite").parquet(out_path)

    w = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


STATE_SCHEMA = "counts binary, waiting binary"
OUT_SCHEMA = "key string, event_id bigint, ts timestamp, active double"


def _apply_sessions(start: str, end: str):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts, waiting = state.get if state.exists else (None, None)
        counts, parts = unpacked(counts, COUNTS), [unpacked(waiting, EVENTS)]
        for pdf in pdfs:
            kind = pdf["_kind"]
            parts.append(events_table(
                pdf["_key"].fillna("None"), pdf["ts"].to_numpy("datetime64[us]").astype(np.int64), pdf["event_id"].to_numpy(np.int64),
                (kind == start).to_numpy(float) - (kind == end).to_numpy(float)))
        mark = state.getCurrentWatermarkMs()
        # nothing at or before the watermark can still arrive, so the order up to it is final
        done, values, rest, counts = released(pa.concat_tables(parts), counts, mark * 1000)
        state.update((packed(counts), packed(rest)))
        if rest.num_rows:
            state.setTimeoutTimestamp(max(pc.min(rest.column("at")).as_py() // 1000 + 1, mark + 1))
        if done.num_rows:
            yield pd.DataFrame({"key": done.column("key").to_pandas(), "event_id": done.column("event_id").to_numpy(),
                                "ts": done.column("at").to_numpy().astype("datetime64[us]"), "active": values})
    return fn


def stream_active_sessions(events: DataFrame, key: str, kind: str, start: str, end: str,
                           watermark: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """E2 on a stream: ``(key, event_id, ts, active)`` per event, in event-time order per key
    whatever order the events arrive in.

    Keys are dealt into ``buckets`` groups. A bucket's state holds its keys' counts and the events that the watermark
    has not yet passed; these are released in (ts, event_id) order once it has, also by a
    timer when the bucket gets no further events. The state is bounded by the
    events of one watermark delay; later ones are dropped by the engine.
    """
    from ..session import ship_package
    ship_package(events.sparkSession)
    fn = _apply_sessions(start, end)
    # watermarks need TIMESTAMP (session time zone), not TIMESTAMP_NTZ
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).select(
        bucket(F.col(key).cast("string"), buckets).alias("_bucket"), F.col(key).cast("string").alias("_key"), "event_id", "ts", F.col(kind).alias("_kind"))
    return (timed.groupBy("_bucket").applyInPandasWithState(fn, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout))


def stream_event_log(events: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """E3 on a stream: append every event to a parquet log."""
    w = (events.writeStream.format("parquet").outputMode("append").option("path", path)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def read_events_stream(spark: SparkSession, folder: str, schema, glob: str | None = None,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over a folder of parquet event files (optionally a name glob)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)
