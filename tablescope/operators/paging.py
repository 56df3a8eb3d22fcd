"""Sorting, paging, head, first-n pairs, latest-k.

Paging uses ``orderBy(...).offset(...).limit(...)``, which Spark runs as a
per-task top-k (TakeOrderedAndProject) instead of a full sort; deep pages
can use keyset paging. Positions for a whole sorted table come from range
partitioning plus per-partition offsets, never from a global window.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import as_number, as_timestamp
from .ordered import freeze


def sort_key(df: DataFrame, by: str) -> Column:
    dtype = df.schema[by].dataType
    if isinstance(dtype, T.NumericType):
        return as_number(F.col(f"`{by}`"), dtype)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return as_timestamp(F.col(f"`{by}`"), dtype)
    return F.col(f"`{by}`")


def sort_orders(df: DataFrame, by: str | None, direction: str = "desc",
                tie_break: list[str] | None = None) -> list[Column]:
    """L1 ordering: nulls last in both directions; ``tie_break`` keeps it deterministic."""
    ties = [F.col(f"`{c}`").asc() for c in (tie_break or [])]
    if not by or by not in df.columns:
        return ties
    key = sort_key(df, by)
    main = key.asc_nulls_last() if str(direction).lower() == "asc" else key.desc_nulls_last()
    return [main] + ties


def with_positions(df: DataFrame, orders: list[Column], name: str = "position") -> DataFrame:
    """1-based position in ``orders`` for every row, computed per range partition."""
    ranged = freeze(df.repartitionByRange(*orders).withColumn("_pid", F.spark_partition_id()))
    local = ranged.withColumn("_lp", F.row_number().over(Window.partitionBy("_pid").orderBy(*orders)))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_off", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per range partition: a bounded broadcast
    return (local.join(F.broadcast(sizes.select("_pid", "_off")), "_pid")
            .withColumn(name, (F.col("_off") + F.col("_lp")).cast("bigint"))
            .drop("_pid", "_lp", "_off"))


#: Spark's top-k allots a buffer of offset and limit rows in every task; a page that lies deeper comes from positions.
TOP_K_ROWS = 100_000


def page(df: DataFrame, page_no: int = 1, page_size: int = 50, orders: list[Column] | None = None,
         name: str = "position") -> DataFrame:
    """L2: rows of one page (clamped ≥ 1) with their 1-based table position.

    A per-task top-k of ``start + size`` rows, or, deeper in the table or past its end, the positions of the
    sorted ranges. For many pages of one order see ``PageIndex``.
    """
    p = max(int(page_no), 1)
    size = max(int(page_size), 1)
    start = (p - 1) * size
    if orders and start + size > TOP_K_ROWS:
        pos = with_positions(df, orders, name)
        return pos.where((F.col(name) > start) & (F.col(name) <= start + size))
    ordered = df.orderBy(*orders) if orders else df
    rows = ordered.offset(start).limit(size) if start else ordered.limit(size)
    # at most page_size rows here, so a window without partition is bounded
    w = Window.orderBy(*orders) if orders else Window.orderBy(F.monotonically_increasing_id())
    return rows.withColumn(name, (F.row_number().over(w) + F.lit(start)).cast("bigint"))


class PageIndex:
    """A table written once in the order of its pages, in one folder per range, with the exact number of rows of each.

    ``page`` adds up the counts (one row per range) and opens only the folders that hold the page, however
    deep it lies; a row's place in its range is written beside it, so nothing is sorted again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, df: DataFrame, orders: list[Column], path: str) -> "PageIndex":
        ranged = df.repartitionByRange(*orders).sortWithinPartitions(*orders)
        place = F.monotonically_increasing_id()
        ranged.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.shiftright(place, 33).cast("int").alias("range"),
                      place.bitwiseAND((1 << 33) - 1).alias("place")).write.partitionBy("range").parquet(f"{path}/rows")
        index = cls(df.sparkSession, path)
        index.rows().groupBy("range").agg(F.max("place").alias("last")).write.parquet(f"{path}/ranges")
        return index

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def page(self, page_no: int = 1, page_size: int = 50, name: str = "position") -> DataFrame:
        """The rows of one page (clamped ≥ 1) with their 1-based position in the whole table."""
        size = max(int(page_size), 1)
        start = (max(int(page_no), 1) - 1) * size
        ranges = self.spark.read.parquet(f"{self.path}/ranges").select("range", (F.col("last") + 1).alias("n"))
        upto = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
        held = ranges.select("range", (upto - F.col("n")).alias("before"), upto.alias("upto"))
        held = held.where((F.col("before") < start + size) & (F.col("upto") > start)).collect()  # ranges that hold the page
        before = F.lit(0).cast("bigint")
        for r in held:
            before = F.when(F.col("range") == r["range"], F.lit(r["before"])).otherwise(before)
        position = before + F.col("place") + 1
        rows = self.rows().where(F.col("range").isin([r["range"] for r in held]))
        return rows.where((position > start) & (position <= start + size)).select("row.*", position.alias(name))


def page_after(df: DataFrame, key: str, last_value, page_size: int = 50) -> DataFrame:
    """Keyset paging: the next ``page_size`` rows after ``last_value`` of a unique key."""
    base = df if last_value is None else df.where(F.col(f"`{key}`") > F.lit(last_value))
    return base.orderBy(F.col(f"`{key}`").asc()).limit(max(int(page_size), 1))


def page_info(df: DataFrame, page_no: int = 1, page_size: int = 50) -> DataFrame:
    """One row ``(page, page_size, total_rows, total_pages)``; empty table → 1/size/0/0."""
    p = max(int(page_no), 1)
    size = max(int(page_size), 1)
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return total.select(
        F.when(F.col("total_rows") == 0, F.lit(1)).otherwise(F.lit(p)).cast("bigint").alias("page"),
        F.lit(size).cast("bigint").alias("page_size"),
        F.col("total_rows").cast("bigint").alias("total_rows"),
        F.ceil(F.col("total_rows") / F.lit(size)).cast("bigint").alias("total_pages"))


def head(df: DataFrame, n: int, orders: list[Column] | None = None) -> DataFrame:
    """L3: first ``n`` rows in row order."""
    return (df.orderBy(*orders) if orders else df).limit(n)


def first_complete_pairs(df: DataFrame, x: str, y: str, n: int, orders: list[Column]) -> DataFrame:
    """L4: the first ``n`` rows (in row order) where both values are present."""
    nx = as_number(F.col(f"`{x}`"), df.schema[x].dataType)
    ny = as_number(F.col(f"`{y}`"), df.schema[y].dataType)
    return (df.where(nx.isNotNull() & ny.isNotNull()).orderBy(*orders).limit(n)
            .select(nx.alias("x"), ny.alias("y")))


def latest(df: DataFrame, ts: str, k: int = 50, tie_break: list[str] | None = None) -> DataFrame:
    """The ``k`` most recent rows (a per-task top-k, not a sort). Rows of one time come in the order of
    ``tie_break``, by default of all other columns that can be ordered."""
    if tie_break is None:
        tie_break = [f.name for f in df.schema.fields if f.name != ts and not isinstance(f.dataType, T.MapType)]
    return df.orderBy(F.col(f"`{ts}`").desc(), *[F.col(f"`{c}`").asc() for c in tie_break]).limit(k)
