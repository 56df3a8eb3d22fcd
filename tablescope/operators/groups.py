"""Category × measure sums, category counts, top-n + Others.

All category columns are unpivoted into ``(cat_column, label)`` rows so one
``groupBy`` (map-side combined, so a hot category costs one row per task)
serves every category × measure pair.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_number, safe, value_text
from ..functions.constants import OTHERS_LABEL
from .reshape import unpivot_structs


def _label(df: DataFrame, name: str, null_label: str | None):
    text = value_text(F.col(f"`{name}`"), df.schema[name].dataType)
    return F.coalesce(text, F.lit(null_label)) if null_label is not None else text


def group_sums(df: DataFrame, categories: list[str], measures: list[str],
               null_label: str | None = None) -> DataFrame:
    """``(cat_column, measure, label, value)``: Σ measure per category value over
    rows where the measure is present; a group with no present value is absent.
    Null categories are dropped unless ``null_label`` names them."""
    nums = [as_number(F.col(f"`{m}`"), df.schema[m].dataType).alias(f"_m{i}") for i, m in enumerate(measures)]
    rows = unpivot_structs(df, [F.struct(F.lit(c).alias("cat_column"), _label(df, c, null_label).alias("label"),
                                         *nums) for c in categories])
    rows = rows.where(F.col("label").isNotNull())
    agg = rows.groupBy("cat_column", "label").agg(
        *[F.sum(f"_m{i}").alias(f"_s{i}") for i in range(len(measures))],
        *[F.count(f"_m{i}").alias(f"_n{i}") for i in range(len(measures))])
    long = agg.select("cat_column", "label", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(f"_s{i}").alias("value"), F.col(f"_n{i}").alias("n"))
        for i, m in enumerate(measures)])))
    return long.where(F.col("n") > 0).drop("n")


def category_counts(df: DataFrame, categories: list[str], null_label: str | None = None) -> DataFrame:
    """``(cat_column, label, value)`` row counts per category value."""
    rows = unpivot_structs(df, [F.struct(F.lit(c).alias("cat_column"), _label(df, c, null_label).alias("label"))
                                for c in categories])
    return (rows.where(F.col("label").isNotNull()).groupBy("cat_column", "label")
            .agg(F.count(F.lit(1)).cast("double").alias("value")))


def top_n_with_others(grouped: DataFrame, keys: list[str], n: int, label: str = "label",
                      value: str = "value", others: str = OTHERS_LABEL, digits: int | None = 4) -> DataFrame:
    """Per key, if more than ``n`` labels keep the ``n-1`` largest and sum
    the rest as ``Others``. Output ``(keys…, rank, label, value)``.

    The ``rank < n`` filter lets Spark keep only n rows per key in each map
    task; the remainder is summed by a second aggregation, so a key with
    millions of labels never sits in one task.
    """
    g = grouped.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(label).asc())
    top = g.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n)
    sizes = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("_groups"))
    # at most n rows per key survive: bounded by n × keys
    marked = (g.join(F.broadcast(top.select(*keys, label, "_rk")), [*keys, label], "left")
              .join(F.broadcast(sizes), keys))
    keep = (F.col("_groups") <= n) | (F.col("_rk") < n)
    out_label = F.when(keep, F.col(label)).otherwise(F.lit(others))
    out_rank = F.when(keep, F.col("_rk")).otherwise(F.lit(n))
    res = marked.groupBy(*keys, out_label.alias(label), out_rank.alias("rank")).agg(F.sum(value).alias(value))
    v = safe(value, digits) if digits is not None else F.col(value)
    return res.select(*keys, F.col("rank").cast("int").alias("rank"), label, v.alias(value))
