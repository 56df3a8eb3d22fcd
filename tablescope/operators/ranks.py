"""Exact order statistics by radix refinement.

A double has a 64-bit key in the same order. One aggregate counts the keys' first
16 bits for all columns (or groups) at once; a running sum over these few counts tells
in which prefix each wanted rank lies. The next round counts the following 16 bits of the
rows with a wanted prefix, and so on, until a prefix holds one value: four rounds at
most, for any number of columns and ranks. Counts combine in the map tasks; no value is
sorted or shuffled, and no buffer follows the number of distinct values.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT_BITS = 16
_UNIT = 1 << 52
_LEAST = -1022


def order_key(x: Column) -> Column:
    """A long that orders doubles as their values do: sign, exponent and mantissa as one number (NULL for NULL and NaN)."""
    a = F.abs(x)
    guess = F.least(F.greatest(F.floor(F.log2(a)), F.lit(_LEAST)), F.lit(1023)).cast("double")
    # the logarithm may be off by a rounding next to powers of two
    exponent = F.when((F.pow(F.lit(2.0), guess) > a) & (guess > _LEAST), guess - 1).when(
        (guess < 1023) & (F.pow(F.lit(2.0), guess + 1) <= a), guess + 1).otherwise(guess)
    # numbers below the least exponent have a mantissa under 1, so they join the order without a gap
    bits = (exponent.cast("long") - _LEAST) * F.lit(_UNIT) + (a / F.pow(F.lit(2.0), exponent) * _UNIT).cast("long")
    top = F.lit(2047 * _UNIT)
    key = F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), top).otherwise(bits)
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x < 0, -key).otherwise(key))


def order_statistics(values: DataFrame, keys: list[str], ranks: Callable[[Column], Column], order: str = "num",
                     weight: str = "cnt") -> DataFrame:
    """The wanted order statistics of every key: ``keys``, ``n``, the fields of ``ranks`` and ``value``.

    ``values`` has ``weight`` copies of each ``order`` value, in any number of rows. ``ranks(n)`` gives, for the
    count ``n`` of a key, an array of structs with a field ``k``, the 1-based rank. Rows without a value do not count.
    """
    rows = values.select(*keys, F.col(order).cast("double").alias("_x"), F.col(weight).cast("long").alias("_w"))
    # the test stands before the key: a filter on the key itself would work the key out twice for every row
    rows = rows.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    spark = values.sparkSession
    found, state = [], None
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        by = list(keys)
        counted = rows
        if state is not None:
            by.append("_prefix")
            # a prefix is a range of values: the key is worked out only for rows in one of the wanted ranges
            wanted = F.broadcast(state.select(*by, "_lo", "_hi").distinct())
            counted = rows.join(wanted, keys).where(F.col("_x").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
        counted = counted.withColumn("_digits", F.shiftright(order_key(F.col("_x")), shift))
        counts = counted.groupBy(*by, "_digits").agg(F.sum("_w").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        # at most 2^16 rows of counts for each prefix
        upto = Window.partitionBy(*by).orderBy("_digits").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_end", F.sum("_c").over(upto))
        if state is None:
            total = F.sum("_c").over(Window.partitionBy(*keys))
            hits = counts.withColumn("n", total).withColumn("_rank", F.explode(ranks(F.col("n")))).withColumn("_k", F.col("_rank.k"))
        else:
            hits = state.drop("_lo", "_hi").join(counts, by)
        hits = hits.where((F.col("_k") > F.col("_end") - F.col("_c")) & (F.col("_k") <= F.col("_end")))
        hits = hits.select(*keys, "n", "_rank", (F.col("_k") - F.col("_end") + F.col("_c")).alias("_k"),
                           F.col("_digits").alias("_prefix"), "_lo", "_hi")
        got = hits.collect()  # one row per key (a column, as a rule) and wanted rank
        found += [r for r in got if r["_lo"] == r["_hi"]]
        left = [r for r in got if r["_lo"] != r["_hi"]]
        if not left:
            break
        state = spark.createDataFrame(left, hits.schema)
    return spark.createDataFrame(found, hits.schema).select(*keys, "n", "_rank.*", F.col("_lo").alias("value"))
