"""The shared frequency table: one row per (column, distinct value).

All per-column statistics that depend on individual values (null and
distinct counts, type ratios, top/bottom values, mode, exact quantiles,
outliers, histograms, monthly counts) are weighted aggregates over this
table, so the whole profile costs one scan and one map-side-combined shuffle
for any number of columns, and every regex or date parse runs once per
distinct value instead of once per cell.
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean_double, py_float_text, to_number, to_timestamp_mixed
from .reshape import unpivot_structs

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def column_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, INTEGRAL):
        return "integral"
    if isinstance(dtype, FRACTIONAL):
        return "fractional"
    if isinstance(dtype, TEMPORAL):
        return "timestamp"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.StringType):
        return "string"
    return "other"


def _cell_struct(df: DataFrame, name: str, pos: int) -> Column:
    dtype = df.schema[name].dataType
    kind = column_kind(dtype)
    c = F.col(f"`{name}`")
    s = F.lit(None).cast("string")
    i = F.lit(None).cast("bigint")
    d = F.lit(None).cast("double")
    t = F.lit(None).cast("timestamp")
    if kind == "integral":
        i = c.cast("bigint")
    elif kind == "fractional":
        d = clean_double(c)
    elif kind == "timestamp":
        t = c.cast("timestamp")
    elif kind == "boolean":
        s = F.when(c, F.lit("True")).when(~c, F.lit("False"))
    elif kind == "string":
        s = c
    else:
        s = F.to_json(c) if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
    return F.struct(F.lit(pos).alias("pos"), s.alias("s"), i.alias("i"), d.alias("d"), t.alias("t"))


def frequency_table(df: DataFrame, columns: list[str] | None = None, persist: bool = False) -> DataFrame:
    """``(column, pos, kind, value, num, ts, cnt)`` for every distinct value.

    ``persist=True`` keeps it (memory, spilling to disk) for plans that read
    it many times; lost blocks are recomputed from the scan.
    ``value`` is the text pandas would print, ``num`` the lenient numeric view
    (NULL when not a number), ``ts`` the timestamp view. Null cells form one
    row with ``value IS NULL``. NaN counts as null.
    """
    cols = list(columns) if columns is not None else list(df.columns)
    structs = [_cell_struct(df, c, df.columns.index(c)) for c in cols]
    cells = unpivot_structs(df, structs)
    # the column's ordinal is the only per-cell key; name and kind are looked up after
    grouped = cells.groupBy("pos", "s", "i", "d", "t").agg(F.count(F.lit(1)).alias("cnt"))
    names = F.array(*[F.lit(c) for c in df.columns])
    kinds = F.array(*[F.lit(column_kind(f.dataType)) for f in df.schema.fields])
    grouped = grouped.select(F.element_at(names, F.col("pos") + 1).alias("column_name"), "pos",
                             F.element_at(kinds, F.col("pos") + 1).alias("kind"), "s", "i", "d", "t", "cnt")
    kind = F.col("kind")
    value = (F.when(kind == "integral", F.col("i").cast("string"))
             .when(kind == "fractional", py_float_text(F.col("d")))
             .when(kind == "timestamp", F.col("t").cast("string"))
             .otherwise(F.col("s")))
    # texts without a digit skip the layouts; the layouts' shapes turn away other free text
    date_like = F.col("s").rlike("[0-9]")
    num = (F.when(kind == "integral", F.col("i").cast("double"))
           .when(kind == "fractional", F.col("d"))
           .when(kind == "string", to_number(F.col("s"))))
    ts = (F.when(kind == "timestamp", F.col("t"))
          .when((kind == "string") & date_like, to_timestamp_mixed(F.col("s"))))
    out = grouped.select("column_name", "pos", "kind", value.alias("value"), num.alias("num"),
                         ts.alias("ts"), "cnt")
    return out.persist(StorageLevel.MEMORY_AND_DISK) if persist else out


def cells_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, pos, kind, value, num, ts, cnt = 1)``: one row per cell, nothing shuffled.

    For aggregates that need no distinct values (bounds, bins, ranges, months): they
    combine in the map tasks, so only their few result rows are shuffled.
    """
    out = []
    for c in columns:
        dtype = df.schema[c].dataType
        kind = column_kind(dtype)
        col = F.col(f"`{c}`")
        nothing, never = F.lit(None).cast("double"), F.lit(None).cast("timestamp")
        num = {"integral": col.cast("double") if kind == "integral" else None,
               "fractional": clean_double(col) if kind == "fractional" else None,
               "string": to_number(col) if kind == "string" else None}.get(kind)
        ts = col.cast("timestamp") if kind == "timestamp" else to_timestamp_mixed(col) if kind == "string" else never
        out.append(F.struct(F.lit(c).alias("column_name"), F.lit(df.columns.index(c)).alias("pos"),
                            F.lit("cell").alias("kind"), F.lit(None).cast("string").alias("value"),
                            (nothing if num is None else num).alias("num"), ts.alias("ts"), F.lit(1).cast("bigint").alias("cnt")))
    return unpivot_structs(df, out)


def numbers(freq: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, pos, num, cnt)``: the numbers of a frequency or cells table, repeats and all, in one scan."""
    return freq.where(F.col("num").isNotNull() & F.col("column_name").isin(list(columns))).select("column_name", "pos", "num", "cnt")


def numeric_frequencies(freq: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, pos, num, cnt)`` with one row per distinct number.

    Typed numeric columns are already unique per number; text columns are
    re-aggregated because ``'$5'`` and ``'5'`` are the same number.
    """
    f = freq.where(F.col("num").isNotNull())
    if columns is not None:
        f = f.where(F.col("column_name").isin(list(columns)))
    typed = f.where(F.col("kind") != "string").select("column_name", "pos", "num", "cnt")
    text = (f.where(F.col("kind") == "string").groupBy("column_name", "pos", "num")
            .agg(F.sum("cnt").alias("cnt")))
    return typed.unionByName(text)
