"""Column profile: summary, per-column statistics, value lists, distributions.

Everything value-dependent comes from the frequency table (``freq``);
moments come from one direct aggregate over the numeric columns. Results
are long tables keyed by ``column`` (and ``pos``, the column's ordinal).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import as_number, fround, py_float_text, safe
from ..functions.constants import TOP_K_VALUES
from .freq import frequency_table, numbers, numeric_frequencies
from .ranks import order_statistics
from .reshape import unpivot_structs

QUARTILES = (0.25, 0.5, 0.75)
#: Least and largest value besides, as boxplots have them.
FIVE_POINTS = (0.0, *QUARTILES, 1.0)


def merge_rows(*frames: DataFrame) -> DataFrame:
    """Combine single-row aggregates into one row (no join)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in out.columns])


def column_counts(freq: DataFrame) -> DataFrame:
    """``(column, pos, total_rows, null_count, non_null, unique_count)``."""
    v = F.col("value")
    return freq.groupBy("column_name", "pos").agg(
        F.sum("cnt").alias("total_rows"),
        F.coalesce(F.sum(F.when(v.isNull(), F.col("cnt"))), F.lit(0)).cast("bigint").alias("null_count"),
        F.coalesce(F.sum(F.when(v.isNotNull(), F.col("cnt"))), F.lit(0)).cast("bigint").alias("non_null"),
        F.count(v).alias("unique_count"),
    )


def null_and_distinct(freq: DataFrame) -> DataFrame:
    """Null count, null % of rows (2 dp), distinct non-null count."""
    c = column_counts(freq)
    pct = fround(F.col("null_count") / F.greatest(F.col("total_rows"), F.lit(1)) * 100, 2)
    return c.select("column_name", "pos", "null_count", pct.alias("null_percentage"), "unique_count")


def _finish_moments(long: DataFrame) -> DataFrame:
    """Sample corrections (pandas' conventions) and rounding of raw moments."""
    n = F.col("n").cast("double")
    # try_divide: ANSI mode raises on division by zero even in an unused CASE branch
    skew = F.try_divide(F.col("sk") * F.sqrt(n * (n - 1)), n - 2)
    kurt = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("ku") + 6)
    return long.select(
        "column_name", "n",
        safe("mn", None).alias("min"), safe("mx", None).alias("max"), safe("av", 4).alias("mean"),
        F.when(n > 1, safe("vr", 4)).otherwise(0.0).alias("variance"),
        F.when(n > 1, safe("sd", 4)).otherwise(0.0).alias("std_dev"),
        F.when(n > 2, safe(skew, 4)).otherwise(0.0).alias("skewness"),
        F.when(n > 3, safe(kurt, 4)).otherwise(0.0).alias("kurtosis"),
    )


def weighted_moments(freq: DataFrame, columns: list[str]) -> DataFrame:
    """Moments from the frequency table (no second scan of the data): means
    first, then centred power sums weighted by ``cnt`` (two small passes over
    distinct values, numerically stable)."""
    fnum = numbers(freq, columns)
    first = fnum.groupBy("column_name").agg(
        F.sum("cnt").alias("n"), F.min("num").alias("mn"), F.max("num").alias("mx"),
        # the mean of a constant column is the constant itself, to the last digit
        F.when(F.min("num") == F.max("num"), F.min("num")).otherwise(F.sum(F.col("num") * F.col("cnt")) / F.sum("cnt")).alias("av"))
    d = F.col("num") - F.col("av")
    w = F.col("cnt")
    # one row per numeric column: a bounded broadcast
    central = fnum.join(F.broadcast(first.select("column_name", "av")), "column_name").groupBy("column_name").agg(
        F.sum(w * d * d).alias("s2"), F.sum(w * d * d * d).alias("s3"), F.sum(w * d * d * d * d).alias("s4"))
    m = first.join(central, "column_name")
    n = F.col("n").cast("double")
    raw = m.select("column_name", "n", "mn", "mx", "av",
                   F.try_divide(F.col("s2"), n - 1).alias("vr"),
                   F.sqrt(F.try_divide(F.col("s2"), n - 1)).alias("sd"),
                   F.try_divide(F.sqrt(n) * F.col("s3"), F.pow(F.col("s2"), 1.5)).alias("sk"),
                   (F.try_divide(n * F.col("s4"), F.col("s2") * F.col("s2")) - 3).alias("ku"))
    return _finish_moments(raw)


def numeric_moments(df: DataFrame, columns: list[str], freq: DataFrame | None = None) -> DataFrame:
    """``(column, n, min, max, mean, variance, std_dev,
    skewness, kurtosis)`` with the sample corrections pandas uses. With a
    frequency table they come from it (see ``weighted_moments``); otherwise
    from one direct pass over ``df``."""
    if freq is not None and columns:
        return weighted_moments(freq, columns)
    if not columns:
        schema = "column string, n bigint, min double, max double, mean double, variance double, " \
                 "std_dev double, skewness double, kurtosis double"
        return df.sparkSession.createDataFrame([], schema)
    # long form: one (column, x) row per cell, then 8 aggregates per column;
    # the generated code does not grow with the number of columns
    cells = unpivot_structs(df, [
        F.struct(F.lit(c).alias("column_name"), as_number(F.col(f"`{c}`"), df.schema[c].dataType).alias("x"))
        for c in columns])
    x = F.col("x")
    long = cells.groupBy("column_name").agg(
        F.count(x).alias("n"), F.min(x).alias("mn"), F.max(x).alias("mx"), F.avg(x).alias("av"),
        F.var_samp(x).alias("vr"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("sk"),
        F.kurtosis(x).alias("ku"))
    return _finish_moments(long)


def quantiles(freq: DataFrame, columns: list[str], ps=QUARTILES) -> DataFrame:
    """Exact linear-interpolated quantiles ``(column_name, p, value)`` (pandas' default).

    The two order statistics around ``h = (n-1)·p`` of all columns and ``ps`` are found
    together by radix refinement (``ranks``), on one path at every size.
    """
    if not columns:
        return freq.sparkSession.createDataFrame([], "column_name string, p double, value double")

    def ranks(n: Column) -> Column:
        structs = []
        for p in ps:
            h = (n - 1) * F.lit(float(p))
            structs += [F.struct(F.lit(float(p)).alias("p"), h.alias("h"), (side(h) + 1).cast("bigint").alias("k"))
                        for side in (F.floor, F.ceil)]
        return F.array_distinct(F.array(*structs))

    picked = order_statistics(numbers(freq, columns), ["column_name"], ranks)
    lo_hi = picked.groupBy("column_name", "p", "h").agg(
        F.min_by("value", "k").alias("lo"), F.max_by("value", "k").alias("hi"), F.min("k").alias("klo"))
    t = F.col("h") - (F.col("klo") - 1)
    # numpy's lerp: a + (b-a)·t below one half, b - (b-a)·(1-t) from one half
    diff = F.col("hi") - F.col("lo")
    val = F.when(t >= 0.5, F.col("hi") - diff * (1 - t)).otherwise(F.col("lo") + diff * t)
    return lo_hi.select("column_name", "p", val.alias("value"))


def modes(freq: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent number, smallest among ties ``(column, mode)``."""
    fnum = numeric_frequencies(freq, columns)
    return fnum.groupBy("column_name").agg(
        F.max_by("num", F.struct(F.col("cnt"), -F.col("num"))).alias("mode"))


def outlier_counts(freq: DataFrame, columns: list[str], quarts: DataFrame) -> DataFrame:
    """Values strictly outside ``[Q1 - 1.5·IQR, Q3 + 1.5·IQR]``."""
    q = quarts.groupBy("column_name").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"))
    fnum = numbers(freq, columns)
    iqr = F.col("q3") - F.col("q1")
    outside = (F.col("num") < F.col("q1") - 1.5 * iqr) | (F.col("num") > F.col("q3") + 1.5 * iqr)
    # one row per numeric column: a bounded broadcast
    return (fnum.join(F.broadcast(q), on="column_name")
            .groupBy("column_name").agg(F.coalesce(F.sum(F.when(outside, F.col("cnt"))), F.lit(0))
                                   .cast("bigint").alias("outliers_count")))


def numeric_stats(df: DataFrame, columns: list[str], freq: DataFrame | None = None, quarts: DataFrame | None = None) -> DataFrame:
    """A7-A13 for the given numeric columns, one row per column, all from the
    frequency table (the data is scanned once). ``quarts`` are these columns' ``quantiles``, where they are known."""
    f = freq if freq is not None else frequency_table(df, columns, persist=True)
    mom = numeric_moments(df, columns, f)
    qs = quarts if quarts is not None else quantiles(f, columns)
    q = qs.groupBy("column_name").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
                                   for p, n in zip(QUARTILES, ("q1", "median", "q3"))])
    out = outlier_counts(f, columns, qs)
    md = modes(f, columns)
    iqr = F.col("q3") - F.col("q1")
    return (mom.join(q, "column_name").join(md, "column_name").join(out, "column_name")
            .select("column_name", "min", "max", "mean", safe("median", 4).alias("median"),
                    safe("mode", None).alias("mode"), "variance", "std_dev",
                    safe("q1", 4).alias("q1"), safe("q3", 4).alias("q3"), safe(iqr, 4).alias("iqr"),
                    "outliers_count", "skewness", "kurtosis"))


def top_values(freq: DataFrame, columns: list[str] | None = None, k: int = TOP_K_VALUES,
               ascending: bool = False) -> DataFrame:
    """``(column, pos, rank, value, count, percentage)``.

    Order: count (desc for top, asc for bottom), then value. The ``rank <= k``
    filter on a row_number window lets Spark keep only k rows per column in
    every map task before the shuffle.
    """
    f = freq.where(F.col("value").isNotNull())
    if columns is not None:
        f = f.where(F.col("column_name").isin(list(columns)))
    totals = f.groupBy("column_name").agg(F.sum("cnt").alias("_total"))
    order = F.col("cnt").asc() if ascending else F.col("cnt").desc()
    w = Window.partitionBy("column_name").orderBy(order, F.col("value").asc())
    ranked = f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    pct = fround(F.col("cnt") / F.greatest(F.col("_total"), F.lit(1)) * 100, 2)
    return (ranked.join(F.broadcast(totals), "column_name")
            .select("column_name", "pos", F.col("rank").cast("int").alias("rank"), "value",
                    F.col("cnt").alias("count"), pct.alias("percentage")))


def _bin_index(v: Column, first: Column, step: Column, last: Column, bins: Column) -> Column:
    """numpy's equal-width bin of ``v``: scaled guess, then edge corrections."""
    edge = lambda i: F.when(i == bins, last).otherwise(i * step + first)
    guess = (((v - first) / (last - first)) * bins).cast("bigint")
    guess = F.when(guess == bins, bins - 1).otherwise(guess)
    dec = F.when(v < edge(guess), guess - 1).otherwise(guess)
    return F.when((v >= edge(dec + 1)) & (dec != bins - 1), dec + 1).otherwise(dec)


def histogram_bounds(freq: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, n, first, last, bins, step)``: bins = clamp(⌊√n⌋, 3, 10);
    a constant column is widened to ±0.5."""
    fnum = numbers(freq, columns)
    return _bounds(fnum.groupBy("column_name").agg(F.sum("cnt").alias("n"), F.min("num").alias("mn"), F.max("num").alias("mx")))


def _bounds(b: DataFrame) -> DataFrame:
    bins = F.least(F.lit(10), F.greatest(F.lit(3), F.floor(F.sqrt(F.col("n"))))).cast("bigint")
    first = F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn"))
    last = F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx"))
    return (b.select("column_name", "n", first.alias("first"), last.alias("last"), bins.alias("bins"))
            .withColumn("step", (F.col("last") - F.col("first")) / F.col("bins")))


def histogram(freq: DataFrame, columns: list[str], label_digits: int = 2, sep: str = " - ") -> DataFrame:
    """``(column, bin, lo, hi, label, count)``; every bin present, last bin closed."""
    # one row per column; its values become literals, so the cells are read once for the bounds and once for the bins
    found = histogram_bounds(freq, columns)
    bounds = freq.sparkSession.createDataFrame(found.collect(), found.schema)
    fnum = numbers(freq, columns)
    idx = _bin_index(F.col("num"), F.col("first"), F.col("step"), F.col("last"), F.col("bins"))
    counts = (fnum.join(F.broadcast(bounds), "column_name")
              .groupBy("column_name", idx.alias("bin")).agg(F.sum("cnt").alias("count")))
    return _histogram_rows(bounds, counts, label_digits, sep)


def table_histogram(df: DataFrame, columns: list[str], label_digits: int = 2, sep: str = " - ") -> DataFrame:
    """A16 straight from a table: one pass for the bounds of all columns, one that counts bins in the map tasks."""
    views = [as_number(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns]
    cells = unpivot_structs(df, [F.struct(F.lit(i).alias("i"), v.alias("num")) for i, v in enumerate(views)])
    names = F.array(*[F.lit(c) for c in columns])
    found = _bounds(cells.groupBy(F.element_at(names, F.col("i") + 1).alias("column_name")).agg(
        F.count("num").alias("n"), F.min("num").alias("mn"), F.max("num").alias("mx")).where(F.col("n") > 0))
    bounds = {r["column_name"]: r for r in found.collect()}  # one row per column
    present = [(i, c) for i, c in enumerate(columns) if c in bounds]
    if not present:
        return _histogram_rows(found, found.select("column_name", F.lit(0).cast("bigint").alias("bin"), F.lit(0).alias("count")), label_digits, sep)
    binned = unpivot_structs(df, [F.struct(F.lit(i).alias("i"), _bin_index(views[i], *[F.lit(bounds[c][k]) for k in (
        "first", "step", "last", "bins")]).alias("bin")) for i, c in present])
    counts = binned.where(F.col("bin").isNotNull()).groupBy("i", "bin").agg(F.count(F.lit(1)).alias("count"))
    counts = counts.select(F.element_at(names, F.col("i") + 1).alias("column_name"), "bin", "count")
    return _histogram_rows(df.sparkSession.createDataFrame(list(bounds.values()), found.schema), counts, label_digits, sep)


def _histogram_rows(bounds: DataFrame, counts: DataFrame, label_digits: int, sep: str) -> DataFrame:
    """All bins of the bounds with their labels and counts."""
    spine = bounds.select("column_name", "first", "last", "step", "bins",
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)).alias("bin"))
    lo = F.col("bin") * F.col("step") + F.col("first")
    hi = F.when(F.col("bin") + 1 == F.col("bins"), F.col("last")) \
        .otherwise((F.col("bin") + 1) * F.col("step") + F.col("first"))
    label = F.concat(py_float_text(safe(lo, label_digits)), F.lit(sep), py_float_text(safe(hi, label_digits)))
    return (spine.join(counts, ["column_name", "bin"], "left")
            .select("column_name", F.col("bin").cast("int").alias("bin"), safe(lo, 4).alias("lo"),
                    safe(hi, 4).alias("hi"), label.alias("label"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def date_ranges(freq: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, min_date, max_date)``; time of day shown only if any value has one."""
    f = freq.where(F.col("ts").isNotNull() & F.col("column_name").isin(list(columns)))
    g = f.groupBy("column_name").agg(
        F.min("ts").alias("mn"), F.max("ts").alias("mx"),
        F.max((F.hour("ts") != 0) | (F.minute("ts") != 0) | (F.second("ts") != 0)).alias("has_time"))
    fmt = lambda c: F.when(F.col("has_time"), F.date_format(c, "yyyy-MM-dd HH:mm:ss")) \
        .otherwise(F.date_format(c, "yyyy-MM-dd"))
    return g.select("column_name", fmt(F.col("mn")).alias("min_date"), fmt(F.col("mx")).alias("max_date"))


def monthly_distribution(freq: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, label yyyy-MM, count)`` for months that occur."""
    f = freq.where(F.col("ts").isNotNull() & F.col("column_name").isin(list(columns)))
    return f.groupBy("column_name", F.date_format("ts", "yyyy-MM").alias("label")).agg(
        F.sum("cnt").cast("bigint").alias("count"))


def estimated_bytes(df: DataFrame) -> Column:
    """A4 (re-aimed): data bytes estimated from text length and fixed widths."""
    parts = []
    for fld in df.schema.fields:
        c = F.col(f"`{fld.name}`")
        if isinstance(fld.dataType, T.StringType):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(fld.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)))
        elif isinstance(fld.dataType, (T.BooleanType, T.ByteType)):
            parts.append(F.lit(1))
        elif isinstance(fld.dataType, (T.ShortType,)):
            parts.append(F.lit(2))
        elif isinstance(fld.dataType, (T.IntegerType, T.FloatType, T.DateType)):
            parts.append(F.lit(4))
        else:
            parts.append(F.lit(8))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.sum(total)


def _fixed_width(dtype: T.DataType):
    if isinstance(dtype, (T.StringType, T.ArrayType, T.MapType, T.StructType)):
        return None
    if isinstance(dtype, (T.BooleanType, T.ByteType)):
        return 1
    if isinstance(dtype, T.ShortType):
        return 2
    if isinstance(dtype, (T.IntegerType, T.FloatType, T.DateType)):
        return 4
    return 8


def estimated_bytes_from_freq(df: DataFrame, freq: DataFrame) -> Column:
    """Same estimate as ``estimated_bytes`` from the frequency table (no data
    scan): fixed widths × count, text length × count."""
    widths = F.array(*[F.lit(_fixed_width(f.dataType)).cast("bigint") for f in df.schema.fields])
    per_value = F.coalesce(F.element_at(widths, F.col("pos") + 1), F.octet_length("value"), F.lit(0))
    return F.sum(F.col("cnt") * per_value)


def row_digests(df: DataFrame) -> list[Column]:
    """Three 64-bit digests of a whole row, in which a null differs from every value and a cell from its neighbour."""
    cells = [F.col(f"`{c}`") for c in df.columns]
    marks = [c.isNull() for c in cells]
    return [F.xxhash64(F.lit(seed), *cells, *marks) for seed in (1, 2, 3)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """A3: rows minus distinct rows, nulls equal, as one row ``(duplicate_rows)``.

    The shuffle key is a 128-bit digest, whatever the rows' length. A third digest that is not one
    for all rows of a key shows that different rows share it; those rows are counted by their cells.
    """
    names = ["_d1", "_d2", "_d3"]
    hashed = df.withColumns(dict(zip(names, row_digests(df))))
    groups = hashed.groupBy("_d1", "_d2").agg(F.count(F.lit(1)).alias("_n"), (F.min("_d3") != F.max("_d3")).alias("_mixed"))
    alike = groups.where(~F.col("_mixed")).agg(F.sum(F.col("_n") - 1).alias("_more"))
    # no key, but for collisions of 128 bits
    mixed = F.broadcast(groups.where("_mixed").select("_d1", "_d2"))
    rest = hashed.join(mixed, ["_d1", "_d2"], "left_semi").groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    rest = rest.agg(F.sum(F.col("_n") - 1).alias("_more"))
    return alike.unionByName(rest).agg(F.coalesce(F.sum("_more"), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def dataset_summary(df: DataFrame, types_df: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """A1-A5 in one row: rows, columns, missing cells and %, duplicates,
    estimated MB, and column counts by kind."""
    f = freq if freq is not None else frequency_table(df)
    ncols = len(df.columns)
    cells = f.agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).cast("bigint")
        .alias("missing_values"),
        (F.sum("cnt") / F.lit(max(ncols, 1))).cast("bigint").alias("total_rows"))
    size = f.agg((estimated_bytes_from_freq(df, f) / F.lit(1024 * 1024)).alias("_mb"))
    kinds = types_df.agg(
        F.sum(F.when(F.col("is_numeric") & ~F.col("is_id"), 1).otherwise(0)).cast("bigint").alias("numeric_columns_count"),
        F.sum(F.when(F.col("is_categorical") | F.col("detected_type").isin("Category", "Boolean", "Text"), 1)
              .otherwise(0)).cast("bigint").alias("categorical_columns_count"),
        F.sum(F.when(F.col("is_date"), 1).otherwise(0)).cast("bigint").alias("date_columns_count"),
        F.sum(F.when(F.col("detected_type") == "Boolean", 1).otherwise(0)).cast("bigint").alias("boolean_columns_count"))
    row = merge_rows(cells, duplicate_rows(df), size, kinds)
    total_cells = F.greatest(F.col("total_rows") * F.lit(ncols), F.lit(1))
    return row.select(
        "total_rows", F.lit(ncols).cast("bigint").alias("total_columns"), "missing_values",
        fround(F.col("missing_values") / total_cells * 100, 2).alias("missing_percentage"),
        "duplicate_rows", safe("_mb", 3).alias("estimated_mb"),
        "numeric_columns_count", "categorical_columns_count", "date_columns_count", "boolean_columns_count")


def approx_quantiles(df: DataFrame, columns: list[str], ps=QUARTILES, accuracy: int = 10_000) -> DataFrame:
    """Opt-in approximate quantiles ``(column_name, p, value)``: ``percentile_approx``
    over the long (column, x) form; mergeable sketches, relative rank error
    about 1/accuracy, one pass and no per-column buffer of distinct values."""
    cells = unpivot_structs(df, [
        F.struct(F.lit(c).alias("column_name"), as_number(F.col(f"`{c}`"), df.schema[c].dataType).alias("x"))
        for c in columns])
    arr = F.array(*[F.lit(float(p)) for p in ps])
    agg = cells.groupBy("column_name").agg(F.percentile_approx("x", arr, accuracy).alias("_q"))
    return agg.select("column_name", F.inline(F.arrays_zip(arr.alias("p"), F.col("_q").alias("value"))))


def approx_distinct(df: DataFrame, columns: list[str], rsd: float = 0.01) -> DataFrame:
    """Opt-in approximate distinct counts ``(column_name, unique_count)`` (HyperLogLog++)."""
    cells = unpivot_structs(df, [F.struct(F.lit(c).alias("column_name"),
                                          F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    return cells.groupBy("column_name").agg(F.approx_count_distinct("v", rsd).alias("unique_count"))
