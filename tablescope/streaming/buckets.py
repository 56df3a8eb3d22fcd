"""Clamped counts of many keys at a time, for the states of the streaming sessions.

Keys are dealt into buckets by their hash and a bucket is one group of the stateful operator, so the cost
of a call (state access, a frame per output) is paid per bucket and not per key. A bucket's
waiting events and its keys' counts are Arrow tables, kept as bytes; what belongs to
a key is worked off with arrays over the whole bucket.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups of a stateful operator; a bucket's state holds the events of one delay of its keys.
BUCKETS = 1024
EVENTS = pa.schema([("key", pa.string()), ("at", pa.int64()), ("event_id", pa.int64()), ("delta", pa.float64())])
COUNTS = pa.schema([("key", pa.string()), ("active", pa.float64())])


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes | None, schema: pa.Schema) -> pa.Table:
    return pa.ipc.open_stream(data).read_all() if data else schema.empty_table()


def events_table(key, at, event_id, delta) -> pa.Table:
    return pa.table([pa.array(key, pa.string(), from_pandas=True), pa.array(at, pa.int64()), pa.array(event_id, pa.int64()),
                     pa.array(delta, pa.float64())], schema=EVENTS)


def released(events: pa.Table, counts: pa.Table, mark: int) -> tuple[pa.Table, np.ndarray, pa.Table, pa.Table]:
    """(events up to ``mark`` by key, time and id, the count after each, the events that wait on, the keys' counts that are not 0)."""
    at = events.column("at").to_numpy()
    due = at <= mark
    done, rest = events.filter(pa.array(due)), events.filter(pa.array(~due))
    if not done.num_rows:
        return done, np.zeros(0), rest, counts
    both = pa.concat_arrays([*counts.column("key").chunks, *done.column("key").chunks]).dictionary_encode(null_encoding="encode")
    codes = both.indices.to_numpy(zero_copy_only=False)
    before = np.zeros(len(both.dictionary))
    before[codes[:counts.num_rows]] = counts.column("active").to_numpy()
    own = codes[counts.num_rows:]
    order = np.lexsort((done.column("event_id").to_numpy(), done.column("at").to_numpy(), own))
    done, own = done.take(pa.array(order)), own[order]
    delta = done.column("delta").to_numpy()
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    lengths = np.diff(np.append(first, len(own)))
    total = np.cumsum(delta)
    y = total + np.repeat(before[own[first]] - (total[first] - delta[first]), lengths)
    # clamp at zero after every step, in closed form: y - min(0, running min of y); each key lies a step of
    # ``apart`` below the one before it, so that the running minimum begins anew with it
    apart = 2.0 * (np.abs(y).max() + 1.0)
    step = np.repeat(np.arange(len(first)), lengths) * apart
    low = np.minimum.accumulate(y - step) + step
    values = y - np.minimum(0.0, low)
    before[own[first]] = values[first + lengths - 1]
    open_ = np.flatnonzero(before)
    left = pa.table([both.dictionary.take(pa.array(open_)), pa.array(before[open_])], schema=COUNTS)
    return done, values, rest, left
