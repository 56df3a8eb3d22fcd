import contextlib
import datetime as dt
import os
import random

from pyspark.sql import functions as F

from tablescope.operators.activity import active_sessions, event_counts, merge_fill, merge_max
from tablescope.operators.ordered import floored_running_sum
from tablescope.streaming.counters import read_events_stream, stream_active_sessions, stream_event_counts


def _sequential(kinds):
    cur, out = 0.0, []
    for k in kinds:
        cur = max(cur + (1 if k == "start" else -1 if k == "end" else 0), 0)
        out.append(cur)
    return out


@contextlib.contextmanager
def many_ranges(spark, n):
    """n shuffle partitions that are not put together, however small."""
    names = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_floored_sessions_by_key_across_ranges(spark):
    """A key over several ranges, many keys in one range, a null key; nothing keyed by user is broadcast."""
    random.seed(6)
    users = [None, 1, 2] + list(range(10, 60))
    rows = [(i, random.choice([None, 1, 1, 1, 2] + users), random.choice(["start", "end", "end", "other"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, user long, kind string")
    with many_ranges(spark, 13):
        out = active_sessions(df, ["event_id"], "kind", "start", "end", ["user"])
        got = {r["event_id"]: (r["active"], r["running"]) for r in out.collect()}
        assert out.rdd.getNumPartitions() > 1
    for u in {u for _, u, _ in rows}:
        mine = [(i, k) for i, w, k in rows if w == u]
        want, plain = _sequential([k for _, k in mine]), 0
        for (i, k), active in zip(mine, want):
            plain += (k == "start") - (k == "end")
            assert got[i] == (active, plain)
    assert out.columns == ["event_id", "user", "kind", "delta", "running", "active"]


def test_floored_sessions_match_loop_across_partitions(spark):
    random.seed(5)
    kinds = ["end", "end", "start"] + [random.choice(["start", "end", "end", "other"]) for _ in range(400)]
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=i), k) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, kind string")
    d = df.withColumn("delta", F.when(F.col("kind") == "start", 1.0).when(F.col("kind") == "end", -1.0).otherwise(0.0))
    with many_ranges(spark, 11):
        out = floored_running_sum(d, ["ts", "event_id"], "delta", 0.0, out="active")
        got = [r["active"] for r in out.orderBy("event_id").collect()]
    assert got == _sequential(kinds)
    assert [r["active"] for r in active_sessions(df, ["ts", "event_id"], "kind", "start", "end")
            .orderBy("event_id").collect()] == _sequential(kinds)


def test_counts_and_merges(spark):
    ev = spark.createDataFrame([("upload",), ("upload",), ("analysis",)], "action string")
    got = {r["key"]: r["value"] for r in event_counts(ev, "action", ["total_visitors", "upload"]).collect()}
    assert got == {"total_visitors": 0, "upload": 2, "analysis": 1}
    t = spark.createDataFrame([("total_visitors", 17), ("total_uploads", 13)], "key string, value long")
    s = spark.createDataFrame([("total_visitors", 20), ("total_uploads", 2), ("total_analyses", 24)], "key string, value long")
    assert {r[0]: r[1] for r in merge_max(t, s).collect()} == {"total_visitors": 20, "total_uploads": 13,
                                                               "total_analyses": 24}
    t2 = spark.createDataFrame([("Admin", ""), ("bob", "h1")], "key string, value string")
    s2 = spark.createDataFrame([(" admin ", "h2"), ("BOB", "h3"), ("carol", "h4")], "key string, value string")
    assert {r[0]: r[1] for r in merge_fill(t2, s2).collect()} == {"admin": "h2", "bob": "h1", "carol": "h4"}


def test_streams_equal_batch(spark, tmp_dir):
    random.seed(9)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=37 * i), i % 3, random.choice(["click", "view", "error"]))
            for i in range(300)]
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    src = os.path.join(tmp_dir, "events")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(src)
    stream = read_events_stream(spark, src, spark.read.parquet(src).schema, max_files_per_trigger=1)
    out = os.path.join(tmp_dir, "counts")
    q = stream_event_counts(stream, out, os.path.join(tmp_dir, "ck1"), "event_type", ["click", "view", "refund"])
    q.awaitTermination()
    batch = {r[0]: r[1] for r in event_counts(spark.read.parquet(src), "event_type", ["click", "view", "refund"]).collect()}
    assert {r[0]: r[1] for r in spark.read.parquet(out).collect()} == batch
    # three files in which every user's events are mixed, one file a trigger, then one later event that moves the watermark
    res = stream_active_sessions(read_events_stream(spark, src, spark.read.parquet(src).schema, max_files_per_trigger=1),
                                 "user_id", "event_type", "click", "view", watermark="5 hours")
    out2, ck2 = os.path.join(tmp_dir, "sessions"), os.path.join(tmp_dir, "ck2")

    def run():
        (res.writeStream.format("parquet").option("path", out2).option("checkpointLocation", ck2)
         .trigger(availableNow=True).start().awaitTermination())

    run()
    expected = spark.read.parquet(src)
    exp = {r["event_id"]: r["active"] for r in active_sessions(expected, ["ts", "event_id"], "event_type",
                                                                "click", "view", partition=["user_id"]).collect()}
    spark.createDataFrame([(10_000, base + dt.timedelta(days=9), 99, "click")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    got = {r["event_id"]: r["active"] for r in spark.read.parquet(out2).collect() if r["event_id"] < 10_000}
    assert got == exp


def test_equal_keys_give_one_row(spark):
    s = spark.createDataFrame([(" a ", "second"), ("A", ""), ("b", "x"), (None, "n")], "key string, value string")
    t = spark.createDataFrame([("B", None), ("b ", "kept")], "key string, value string")
    assert {r[0]: r[1] for r in merge_fill(t, s).collect()} == {"a": "second", "b": "kept", None: "n"}


def test_stream_query_keeps_events_of_several_months(spark, tmp_dir):
    from collections import defaultdict
    from datetime import datetime, timedelta

    from tablescope.plans.activity_queries import q_stream_active_sessions
    kinds = ("click", "view", "click", "buy", "view", "view")
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=7 * i), i % 3, kinds[i * 5 % 6]) for i in range(700)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_dir}/events.parquet")
    active, want = defaultdict(float), {}
    for i, _, user, kind in rows:
        active[user] = max(0.0, active[user] + {"click": 1.0, "view": -1.0}.get(kind, 0.0))
        want[i] = (str(user), active[user])
    got = {r.event_id: (r.key, r.active) for r in q_stream_active_sessions(spark, tmp_dir).collect()}
    assert got == want


def test_sessions_set_late_events_apart(spark, tmp_dir):
    """Two files of one hour each, a delay of ten minutes: what the second file brings from before that is late."""
    from tablescope.streaming.sessions import stream_sessions, write_sessions
    base = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    src, out, ck = (os.path.join(tmp_dir, n) for n in ("late-src", "late-out", "late-ck"))
    random.seed(11)
    kinds = ["click", "view", "click", "error"]
    early = [(i, base + dt.timedelta(minutes=i), i % 2, random.choice(kinds)) for i in range(60) if i % 7 != 3]
    later = [(i, base + dt.timedelta(minutes=i), i % 2, random.choice(kinds)) for i in range(120) if i >= 60 or i % 7 == 3]
    spark.createDataFrame(early, schema).coalesce(1).write.parquet(src)
    sessions = stream_sessions(read_events_stream(spark, src, spark.read.parquet(src).schema, max_files_per_trigger=1),
                               "user_id", "event_type", "click", "view", "10 minutes")
    for more in (later, [(999, base + dt.timedelta(days=9), None, "click")]):
        write_sessions(sessions, out, ck)
        spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(src)
    write_sessions(sessions, out, ck)
    mark = base + dt.timedelta(minutes=59 - 10)
    late = {i for i, ts, _, _ in later if ts <= mark}
    rows = [r for r in early + later if r[0] not in late]
    want = {}
    for user in (0, 1):
        mine = sorted((ts, i, k) for i, ts, u, k in rows if u == user)
        active = _sequential([{"click": "start", "view": "end"}.get(k, k) for _, _, k in mine])
        want |= {i: a for (_, i, _), a in zip(mine, active)}
    got = [r for r in spark.read.parquet(out).collect() if r["key"] is not None]
    assert {r["event_id"] for r in got if str(r["late"]) in ("true", "True")} == late and late
    assert {r["event_id"]: r["active"] for r in got if r["event_id"] not in late} == want


def test_sessions_are_grouped_by_buckets_of_keys(spark):
    """More keys than buckets: a group of the stateful operator holds many keys, each counted by its own events."""
    import numpy as np

    from tablescope.streaming.buckets import BUCKETS, COUNTS, bucket, events_table, released
    keys = spark.range(20 * BUCKETS).select(bucket(F.col("id").cast("string")).alias("b"))
    assert keys.distinct().count() <= BUCKETS
    random.seed(5)
    rows = [(random.choice(["a", "b", None, "c"]), at, i, random.choice([1.0, -1.0, 0.0])) for i, at in enumerate(random.choices(range(400), k=500))]
    counts, got, rest = COUNTS.empty_table(), {}, events_table(*zip(*rows))
    for mark in (-1, 150, 150, 320, 1000):
        done, values, rest, counts = released(rest, counts, mark)
        got |= dict(zip(done.column("event_id").to_pylist(), np.asarray(values).tolist()))
        assert 0.0 not in counts.column("active").to_pylist()
    assert not rest.num_rows
    want = {}
    for key in {r[0] for r in rows}:
        active = 0.0
        for _, at, i, delta in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            want[i] = active = max(0.0, active + delta)
    assert got == want
