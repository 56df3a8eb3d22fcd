"""Registered queries E1-E6, W5, J3, J4 (batch and streaming) with DuckDB twins.

The driver's ``events`` table is the event log: ``event_type`` is the action,
``click`` opens a session and ``view`` closes one (a convention of these
queries; the operators take any start/end labels).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.activity import active_sessions, counter_value, event_counts, merge_fill, merge_max
from ..session import scratch_path
from ..streaming.counters import read_events_stream, stream_active_sessions, stream_event_counts
from .tables import load

SPARK, SQL = {}, {}
KNOWN = ["view", "click", "error", "purchase", "signup", "refund"]
MID = "2024-01-16 00:00:00"


def register(name, sql=None):
    def deco(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


COUNTS_SQL = """WITH k AS (SELECT unnest(['view', 'click', 'error', 'purchase', 'signup', 'refund']) AS key),
c AS (SELECT event_type AS key, count(*) AS value FROM events GROUP BY 1)
SELECT coalesce(k.key, c.key) AS key, coalesce(c.value, 0)::BIGINT AS value FROM k FULL JOIN c ON k.key = c.key"""


@register("event_counts", COUNTS_SQL)
def q_event_counts(spark, sf):
    return event_counts(load(spark, sf, "events"), "event_type", KNOWN)


@register("counter_value", """SELECT count(*)::BIGINT AS value FROM events WHERE event_type = 'purchase'""")
def q_counter_value(spark, sf):
    return counter_value(load(spark, sf, "events"), "purchase", "event_type")


@register("counter_value_absent", """SELECT 'refund' AS key, count(*)::BIGINT AS value FROM events WHERE event_type = 'refund'
UNION ALL SELECT 'click', count(*)::BIGINT FROM events WHERE event_type = 'click'""")
def q_counter_value_absent(spark, sf):
    """An action that never occurred counts 0, beside one that did."""
    ev = load(spark, sf, "events")
    one = lambda k: counter_value(ev, k, "event_type").select(F.lit(k).alias("key"), "value")
    return one("refund").unionByName(one("click"))


SESSIONS_SQL = """WITH d AS (SELECT *, CASE WHEN event_type = 'click' THEN 1.0 WHEN event_type = 'view' THEN -1.0 ELSE 0.0 END AS delta
  FROM events),
s AS (SELECT *, sum(delta) OVER ({part} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM d),
m AS (SELECT *, min(running) OVER ({part} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mn FROM s)
SELECT event_id, ts, user_id, event_type, value, props, delta, running, running - least(0.0, mn) AS active FROM m"""


@register("active_sessions", SESSIONS_SQL.format(part=""))
def q_active_sessions(spark, sf):
    ev = load(spark, sf, "events")
    return active_sessions(ev, ["ts", "event_id"], "event_type", "click", "view")


@register("active_sessions_by_user", SESSIONS_SQL.format(part="PARTITION BY user_id"))
def q_active_sessions_by_user(spark, sf):
    ev = load(spark, sf, "events")
    return active_sessions(ev, ["ts", "event_id"], "event_type", "click", "view", partition=["user_id"])


def _half_counts(ev, first: bool):
    cond = F.col("ts") < F.lit(MID).cast("timestamp")
    return ev.where(cond if first else ~cond).groupBy(F.col("event_type").alias("key")).agg(
        F.count(F.lit(1)).alias("value"))


@register("merge_max", f"""WITH t AS (SELECT event_type AS key, count(*) AS v FROM events WHERE ts < TIMESTAMP '{MID}' AND event_type <> 'signup' GROUP BY 1),
s AS (SELECT event_type AS key, count(*) AS v FROM events WHERE ts >= TIMESTAMP '{MID}' GROUP BY 1)
SELECT coalesce(t.key, s.key) AS key, greatest(coalesce(t.v, s.v), coalesce(s.v, t.v)) AS value FROM t FULL JOIN s ON t.key = s.key""")
def q_merge_max(spark, sf):
    ev = load(spark, sf, "events")
    target = _half_counts(ev.where(F.col("event_type") != "signup"), True)
    return merge_max(target, _half_counts(ev, False))


@register("merge_fill", f"""WITH t AS (SELECT lower(trim('User-' || user_id)) AS key,
    CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN '' ELSE arg_max(event_type, (ts, event_id)) END AS v
  FROM events WHERE ts < TIMESTAMP '{MID}' GROUP BY user_id),
s AS (SELECT lower(trim(' user-' || user_id || ' ')) AS key, arg_max(event_type, (ts, event_id)) AS v
  FROM events WHERE ts >= TIMESTAMP '{MID}' GROUP BY user_id)
SELECT coalesce(t.key, s.key) AS key,
  CASE WHEN t.key IS NULL THEN s.v WHEN coalesce(trim(t.v), '') = '' AND coalesce(trim(s.v), '') <> '' THEN s.v ELSE t.v END AS value
FROM t FULL JOIN s ON t.key = s.key""")
def q_merge_fill(spark, sf):
    ev = load(spark, sf, "events")
    first = F.col("ts") < F.lit(MID).cast("timestamp")
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    target = (ev.where(first).groupBy("user_id").agg(last.alias("v"))
              .select(F.concat(F.lit("User-"), F.col("user_id").cast("string")).alias("key"),
                      F.when(F.col("v") == "error", F.lit("")).otherwise(F.col("v")).alias("value")))
    source = (ev.where(~first).groupBy("user_id").agg(last.alias("value"))
              .select(F.concat(F.lit(" user-"), F.col("user_id").cast("string"), F.lit(" ")).alias("key"), "value"))
    return merge_fill(target, source)


@register("merge_fill_clash", """WITH k AS (SELECT DISTINCT user_id FROM events),
t AS (SELECT lower(trim('User-' || user_id)) AS key, CASE WHEN user_id % 3 = 0 THEN '' ELSE 't' || user_id END AS v FROM k WHERE user_id % 2 = 0)
SELECT coalesce(t.key, 'user-' || k.user_id) AS key,
  CASE WHEN t.key IS NULL OR t.v = '' THEN CASE WHEN k.user_id % 5 = 0 THEN 'lower' ELSE 'upper' END ELSE t.v END AS value
FROM k LEFT JOIN t ON t.key = 'user-' || k.user_id""")
def q_merge_fill_clash(spark, sf):
    """J4 where both spellings of a key stand in the source; the upper-case one sorts first and is empty for every fifth key."""
    users = load(spark, sf, "events").select("user_id").distinct()
    n = F.col("user_id").cast("string")
    target = users.where("user_id % 2 = 0").select(
        F.concat(F.lit("User-"), n).alias("key"), F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("t"), n)).alias("value"))
    upper = users.select(F.concat(F.lit("USER-"), n).alias("key"), F.when(F.col("user_id") % 5 == 0, "").otherwise("upper").alias("value"))
    lower = users.select(F.concat(F.lit("user-"), n, F.lit(" ")).alias("key"), F.lit("lower").alias("value"))
    return merge_fill(target, upper.unionByName(lower))


@register("stream_event_counts", COUNTS_SQL)
def q_stream_event_counts(spark, sf):
    """E1 as a Structured Streaming query over the events file (availableNow)."""
    ev = load(spark, sf, "events")
    stream = read_events_stream(spark, sf.rstrip('/'), ev.schema, glob="events.parquet")
    out = scratch_path(spark, "event-counts")
    q = stream_event_counts(stream, out, scratch_path(spark, "event-counts-ckpt"), "event_type", KNOWN)
    q.awaitTermination()
    return spark.read.parquet(out)


@register("stream_active_sessions_by_user", """WITH d AS (SELECT *, CASE WHEN event_type = 'click' THEN 1.0 WHEN event_type = 'view' THEN -1.0 ELSE 0.0 END AS delta FROM events),
s AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM d),
m AS (SELECT *, min(running) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mn FROM s)
SELECT CAST(user_id AS VARCHAR) AS key, event_id, ts, running - least(0.0, mn) AS active FROM m""")
def q_stream_active_sessions(spark, sf):
    """E2 per user as a stateful stream over four portions that overlap in time, one portion a run.

    Every portion may span the whole table, so the watermark's delay is the table's span. A last one
    with one later event (of no user) moves the watermark past all others."""
    ev = load(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    days = (ev.agg((F.max(at) - F.min(at)).alias("span")).first()["span"] or 0) // 86_400_000_000 + 1
    folder, out = scratch_path(spark, "session-events"), scratch_path(spark, "sessions")
    files = ev.withColumn("_part", F.pmod(F.xxhash64("event_id"), F.lit(4)))
    portions = [files.where(F.col("_part") == k).drop("_part") for k in range(4)]
    late = ev.agg((F.max("ts") + F.expr(f"INTERVAL {2 * days + 1} DAYS")).alias("ts")).select(
        *[F.col("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in ev.dtypes])
    portions[0].write.mode("append").parquet(folder)
    stream = read_events_stream(spark, folder, ev.schema)
    res = stream_active_sessions(stream.where("user_id IS NOT NULL OR event_id IS NULL"), "user_id", "event_type",
                                 "click", "view", watermark=f"{days} days")
    checkpoint = scratch_path(spark, "sessions-ckpt")

    def run():
        q = (res.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    for more in [*portions[1:], late.coalesce(1)]:
        more.write.mode("append").parquet(folder)
        run()
    return spark.read.parquet(out).where("key IS NOT NULL AND event_id IS NOT NULL")


@register("stream_sessions_late", """WITH b AS (SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS t0, max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () AS span FROM events),
f AS (SELECT *, least(4, (us - t0) * 5 // span) + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END AS file FROM b),
w AS (SELECT file, max(max(us)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - (span // 10000000) * 1000 AS mark FROM f GROUP BY file, span),
l AS (SELECT f.*, coalesce(us <= w.mark * 1000, false) AS late, CASE WHEN event_type = 'click' THEN 1.0 WHEN event_type = 'view' THEN -1.0 ELSE 0.0 END AS delta
  FROM f JOIN w USING (file)),
s AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM l WHERE NOT late),
m AS (SELECT *, min(running) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mn FROM s)
SELECT CAST(user_id AS VARCHAR) AS key, event_id, ts, running - least(0.0, mn) AS active, late FROM m
UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, ts, NULL, late FROM l WHERE late""")
def q_stream_sessions_late(spark, sf):
    """E2 with a delay of a tenth of the table's span: six portions in the order of time, every tenth event one portion later than it should; one portion a run.

    Of those, the ones that the watermark has passed come out as late; all others count as in the batch form.
    """
    from ..streaming.sessions import stream_sessions, write_sessions
    ev = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    row = ev.agg(F.min(at).alias("t0"), (F.max(at) - F.min(at)).alias("span"), F.max("ts").alias("last")).first()
    t0, span = row["t0"] or 0, max(row["span"] or 1, 1)
    file = F.least(F.lit(4), F.floor((at - t0) * 5 / F.lit(span))) + F.when(F.col("event_id") % 10 == 3, 1).otherwise(0)
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("late-events", "late-sessions", "late-ckpt"))
    files = ev.withColumn("_file", file)
    portions = [files.where(F.col("_file") == k).drop("_file") for k in range(6)]
    portions[0].write.mode("append").parquet(folder)
    sessions = stream_sessions(read_events_stream(spark, folder, ev.schema), "user_id", "event_type", "click", "view",
                               f"{span // 10_000_000} seconds")
    write_sessions(sessions, out, checkpoint)
    # one event of no user, behind all others, moves the watermark past them
    after = ev.agg(F.timestamp_micros(F.max(at) + 2 * span).alias("ts")).select(
        *[F.col("ts") if c == "ts" else F.lit(-1 if c == "event_id" else None).cast(t).alias(c) for c, t in ev.dtypes])
    for more in [*portions[1:], after.coalesce(1)]:
        more.write.mode("append").parquet(folder)
        write_sessions(sessions, out, checkpoint)
    return spark.read.parquet(out).where("key IS NOT NULL").select("key", "event_id", "ts", "active", F.col("late").cast("boolean").alias("late"))


@register("event_log_append", "SELECT * FROM events")
def q_event_log_append(spark, sf):
    """The log is appended in two batches (before / after mid-month) and read back."""
    from ..operators.activity import append_events
    ev = load(spark, sf, "events")
    path = scratch_path(spark, "event-log")
    first = F.col("ts") < F.lit(MID).cast("timestamp")
    append_events(ev.where(first), path)
    append_events(ev.where(~first), path)
    return spark.read.parquet(path)


@register("stream_event_log", "SELECT * FROM events")
def q_stream_event_log(spark, sf):
    """E3 on a stream: every event appended to a parquet log with a checkpoint."""
    from ..streaming.counters import stream_event_log
    ev = load(spark, sf, "events")
    stream = read_events_stream(spark, sf.rstrip('/'), ev.schema, glob="events.parquet")
    path = scratch_path(spark, "event-log-stream")
    stream_event_log(stream, path, scratch_path(spark, "event-log-ckpt")).awaitTermination()
    return spark.read.parquet(path)
