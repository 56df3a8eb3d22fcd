"""Ordered prefix sums without a global window.

A window with no partition key (or one key holding a third of the rows)
runs in a single task. Here the data is range-partitioned instead (Spark samples the
key to balance the ranges and takes their number from the shuffle
partitions), the range is frozen by persisting that one shuffled result (a recomputed block comes from the same
shuffle dependency, so it lands in the same range; ``reliable=True``
writes a checkpoint to the shared folder instead), and one row per range carries
what the ranges before it add. Per-task work is bounded by
the size of a range whatever the skew of the grouping key.
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def freeze(df: DataFrame, reliable: bool = False) -> DataFrame:
    """Pin a result whose partition ids must not change between its uses."""
    if reliable:
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def range_frozen(df: DataFrame, by: list[str], order: list[str], reliable: bool = False) -> DataFrame:
    """Range-partition on ``by + order`` and freeze the range as ``_pid``."""
    ranged = df.repartitionByRange(*[F.col(c) for c in by + order])
    return freeze(ranged.withColumn("_pid", F.spark_partition_id()), reliable)


def floored_running_sum(df: DataFrame, order: list[str], delta: str, floor: float = 0.0,
                        partition: list[str] | None = None, out: str = "value") -> DataFrame:
    """Running value that starts at ``floor``, adds ``delta`` in ``order`` and is
    clamped at ``floor`` after every step (``v = max(v + d, floor)``).

    A run of rows maps the value before it to ``max(v + a, b)``, and such functions compose; with S the
    plain prefix sum the clamped value is ``floor + S - least(0, min over the prefix of S)``. Ranges are sorted
    by key and order, so only a range's first key can have rows in the ranges before it, as their last
    key: each range gets one row, the composed function of that key's rows before it, whatever the number of
    keys. Adds ``running`` (plain) and ``out`` (clamped, default ``value``).
    """
    part = list(partition or [])
    key = F.struct(*[F.col(c) for c in part]) if part else F.lit(0)
    r = range_frozen(df.withColumn("_key", key), part, order)
    wl = (Window.partitionBy("_key", "_pid").orderBy(*order)
          .rowsBetween(Window.unboundedPreceding, 0))
    local = (r.withColumn("_ls", F.sum(delta).over(wl))
             .withColumn("_lmin", F.min(F.col("_ls")).over(wl)))
    sums = local.groupBy("_pid", "_key").agg(F.sum(delta).alias("tot"), F.min("_ls").alias("low"))
    # one row per range from here on: its first key, and its last key with that key's sum and lowest prefix
    ranges = sums.groupBy("_pid").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last"),
                                      F.max_by(F.struct("tot", "low"), "_key").alias("_tail"))
    before = Window.partitionBy("_last").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_last").orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("_off", F.coalesce(F.sum("_tail.tot").over(before), F.lit(0)))
    ranges = ranges.withColumn("_end", F.col("_off") + F.col("_tail.tot")).withColumn(
        "_low", F.min(F.col("_off") + F.col("_tail.low")).over(upto))
    neighbour = Window.orderBy("_pid")
    came = F.lag(F.struct(F.col("_last").alias("key"), F.col("_end").alias("off"), F.col("_low").alias("low"))).over(neighbour)
    carried = ranges.withColumn("_c", came).where(F.col("_c.key").eqNullSafe(F.col("_first")))
    carried = carried.select(F.col("_pid").alias("_p"), F.col("_first"), F.col("_c.off").alias("_carried"), F.col("_c.low").alias("_lowest"))
    joined = local.join(F.broadcast(carried), (F.col("_pid") == F.col("_p")) & F.col("_key").eqNullSafe(F.col("_first")), "left")
    off = F.coalesce("_carried", F.lit(0))
    running = off + F.col("_ls")
    prefix_min = F.least(F.coalesce("_lowest", F.lit(float("inf"))), off + F.col("_lmin"))
    value = F.lit(floor) + running - F.least(F.lit(0.0), prefix_min)
    return (joined.withColumn("running", running).withColumn(out, value)
            .drop("_ls", "_lmin", "_key", "_first", "_carried", "_lowest", "_p", "_pid"))
