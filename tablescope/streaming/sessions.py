"""E2 on a stream with ``transformWithState``: clamped session counts, late events set apart.

Keys are dealt into buckets. A bucket's state is its keys' counts and a list of pieces with the events that the watermark
has not passed yet. A timer at the earliest of them releases, in (time, id) order, all that the watermark has
passed by then and is set anew for the rest; a key whose count is 0 and which has no
events waiting keeps no state at all. An event at or before the watermark on its arrival is late: it comes
out at once with ``late`` set and no count, and touches no state. The delay is the
caller's; the state holds the events of one delay, not of the table.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .buckets import BUCKETS, COUNTS, EVENTS, bucket, events_table, packed, released, unpacked

OUT_SCHEMA = "key string, event_id bigint, ts timestamp, active double, late boolean"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rows(events: pa.Table, active: np.ndarray, late: bool) -> pd.DataFrame:
    """Output rows of events (microseconds) with their counts."""
    return pd.DataFrame({"key": events.column("key").to_pandas(), "event_id": events.column("event_id").to_numpy(),
                         "ts": events.column("at").to_numpy().astype("datetime64[us]"), "active": active, "late": late})


class _Sessions(StatefulProcessor):
    def __init__(self, start: str, end: str):
        self.start, self.end = start, end

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "counts binary")
        self.waiting = handle.getListState("waiting", "events binary")

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [events_table(pdf["key"], pdf["at"].to_numpy(np.int64), pdf["event_id"].to_numpy(np.int64),
                              (pdf["kind"] == self.start).to_numpy(float) - (pdf["kind"] == self.end).to_numpy(float)) for pdf in rows]
        events = pa.concat_tables(parts)
        passed = pc.less_equal(events.column("at"), mark)
        late, new = events.filter(passed), events.filter(pc.invert(passed))
        if new.num_rows:
            # timers that are later than the earliest one find nothing left to release
            self.handle.registerTimer(pc.min(new.column("at")).as_py() // 1000 + 1)
            self.waiting.appendList([(packed(new),)])
        if late.num_rows:
            yield _rows(late, np.full(late.num_rows, np.nan), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [unpacked(e[0], EVENTS) for e in self.waiting.get()] if self.waiting.exists() else []
        counts = unpacked(self.counts.get()[0] if self.counts.exists() else None, COUNTS)
        done, values, rest, counts = released(pa.concat_tables([EVENTS.empty_table(), *parts]), counts, mark)
        if not done.num_rows:
            return
        if rest.num_rows:
            self.waiting.put([(packed(rest),)])
            self.handle.registerTimer(pc.min(rest.column("at")).as_py() // 1000 + 1)
        else:
            self.waiting.clear()
        if counts.num_rows:
            self.counts.update((packed(counts),))
        else:
            self.counts.clear()
        yield _rows(done, values, False)

    def close(self) -> None:
        pass


def stream_sessions(events: DataFrame, key: str, kind: str, start: str, end: str, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """``(key, event_id, ts, active, late)`` per event of a stream (ts, event_id, ``key``, ``kind``)."""
    from ..session import ship_package
    spark = events.sparkSession
    ship_package(spark)
    spark.conf.set(*PROVIDER)
    # watermarks need TIMESTAMP; the time goes on as a number, so the engine does not drop late rows before they are counted
    # names without an underscore: the frames are made of named tuples
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(
        bucket(F.col(key).cast("string"), buckets).alias("bucket"), F.col(key).cast("string").alias("key"), F.unix_micros("ts").alias("at"), F.col("event_id").cast("bigint").alias("event_id"),
        F.col(kind).alias("kind"))
    return timed.groupBy("bucket").transformWithStateInPandas(_Sessions(start, end), OUT_SCHEMA, "append", "eventTime")


def write_sessions(sessions: DataFrame, path: str, checkpoint: str):
    """Run once over what is available; events in time go to ``path/late=false``, late ones to a table of their own."""
    query = (sessions.writeStream.format("parquet").outputMode("append").partitionBy("late").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query
