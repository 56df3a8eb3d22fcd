"""Ready-to-plot chart datasets as one long table.

Every chart family returns rows of ``CHART_COLUMNS``: the chart's identity
(``chart_id`` = xxhash64 of title, type and category), its labels, and one
row per point (``pos``, ``label``, ``x``, ``y``, ``z``). Drawing is not done.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import as_number, filled, safe, value_text
from ..functions.constants import (BAR_HORIZONTAL_OVER, BAR_TOP_N, CHART_MEASURES, CHART_TEXTS, PIE_TOP_N,
                                   SCATTER_POINTS)
from ..session import ship_package
from .freq import frequency_table
from .groups import category_counts, group_sums, top_n_with_others
from .profile import FIVE_POINTS, histogram, quantiles
from .ranks import order_statistics
from .timeseries import resample_sums

CHART_COLUMNS = ["chart_id", "type", "category", "title", "x_label", "y_label", "series",
                 "pos", "label", "x", "y", "z", "description"]
CHART_LABELS = {"Category", "Text", "Unique IDs", "Boolean"}


def chart_columns(types_rows: list[dict]) -> dict[str, list[str]]:
    """Numeric / categorical / date column lists the reference charts from."""
    num = [t["column_name"] for t in types_rows if t["is_numeric"] and not t["exclude_from_charts"]]
    cat = [t["column_name"] for t in types_rows
           if (t["is_categorical"] or t["is_id"] or t["detected_type"] in CHART_LABELS)
           and not t["exclude_from_charts"]]
    dat = [t["column_name"] for t in types_rows if t["is_date"] and not t["exclude_from_charts"]]
    return {"numeric": num, "categorical": cat, "date": dat}


def _chart(df: DataFrame, title: Column, ctype, category: str, x_label, y_label, series,
           pos: Column, label=None, x=None, y=None, z=None, description=None) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    t = lit(ctype)
    return df.select(
        F.xxhash64(title, t, F.lit(category)).alias("chart_id"), t.alias("type"), F.lit(category).alias("category"),
        title.alias("title"), lit(x_label).cast("string").alias("x_label"), lit(y_label).cast("string").alias("y_label"),
        lit(series).cast("string").alias("series"), pos.cast("int").alias("pos"),
        lit(label).cast("string").alias("label"), lit(x).cast("double").alias("x"),
        lit(y).cast("double").alias("y"), lit(z).cast("double").alias("z"), lit(description).cast("string").alias("description"))


def _texts(kind: str, x: Column | str = "", y: Column | str = "") -> dict:
    """Title and description of a kind of chart."""
    title, description = CHART_TEXTS[kind]
    return {"title": filled(title, x=x, y=y), "description": filled(description, x=x, y=y)}


def trend_charts(df: DataFrame, date_cols: list[str], num_cols: list[str]) -> DataFrame:
    """G1 line and G2 area: every date column × first four numeric columns."""
    pairs = [(d, m) for d in date_cols for m in num_cols[:CHART_MEASURES]]
    if not pairs:
        return None
    ts = resample_sums(df, pairs)
    # a date column needs at least two parsed dates
    ok_dates = [F.struct(F.lit(d).alias("date_column"),
                         F.count(F.col(f"`{d}`")).alias("n")) for d in date_cols]
    enough = df.agg(F.array(*ok_dates).alias("a")).select(F.inline("a")).where(F.col("n") >= 2)
    ts = ts.join(F.broadcast(enough.select("date_column")), "date_column", "left_semi")
    w = Window.partitionBy("date_column", "measure").orderBy("period")
    ts = ts.withColumn("_pos", F.row_number().over(w) - 1)
    d, m = F.col("date_column"), F.col("measure")
    line = _chart(ts, ctype="line", category="trend", x_label=d, y_label=m, series=m, pos=F.col("_pos"), label=F.col("label"),
                  y=F.col("value"), **_texts("line", d, m))
    area = _chart(ts, ctype="area", category="trend", x_label=d, y_label=m, series=m, pos=F.col("_pos"), label=F.col("label"),
                  y=F.col("value"), z=F.col("running_value"), **_texts("area", d, m))
    return line.unionByName(area)


def category_charts(df: DataFrame, cat_cols: list[str], num_cols: list[str],
                    null_label: str | None = None) -> DataFrame:
    """G3 bar / horizontal bar (top 15), G4 pie and G5 donut (top 10) of Σ measure by category."""
    if not cat_cols or not num_cols:
        return None
    sums = group_sums(df, cat_cols, num_cols[:CHART_MEASURES], null_label)
    keys = ["cat_column", "measure"]
    bar = top_n_with_others(sums, keys, BAR_TOP_N)
    n_labels = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    bar = bar.withColumn("_t", F.when(n_labels > BAR_HORIZONTAL_OVER, "horizontal_bar").otherwise("bar"))
    pie = top_n_with_others(sums, keys, PIE_TOP_N)
    c, m = F.col("cat_column"), F.col("measure")
    point = {"pos": F.col("rank") - 1, "label": F.col("label"), "y": F.col("value")}
    out = _chart(bar, ctype=F.col("_t"), category="comparison", x_label=c, y_label=m, series=m, **point, **_texts("bar", c, m))
    for kind in ("pie", "donut"):
        out = out.unionByName(_chart(pie, ctype=kind, category="distribution", x_label=None, y_label=None, series=m, **point,
                                     **_texts(kind, c, m)))
    return out


def histogram_charts(freq: DataFrame, num_cols: list[str]) -> DataFrame:
    """Equal-width histogram (type ``bar``), needs ≥ 3 values; 4-dp labels."""
    if not num_cols:
        return None
    h = histogram(freq, num_cols, label_digits=4, sep=" – ")
    n = F.sum("count").over(Window.partitionBy("column_name"))
    h = h.withColumn("_n", n).where(F.col("_n") >= 3)
    c = F.col("column_name")
    return _chart(h, ctype="bar", category="distribution", x_label=c, y_label="Count", series="Frequency", pos=F.col("bin"),
                  label=F.col("label"), y=F.col("count"), **_texts("histogram", c))


def boxplot_charts(df: DataFrame, freq: DataFrame, num_cols: list[str], five: DataFrame | None = None) -> DataFrame:
    """Five-number summary (min, Q1, median, Q3, max), needs ≥ 3 values; ``five`` are the columns' quantiles, where known."""
    if not num_cols:
        return None
    q = five.where(F.col("column_name").isin(num_cols)) if five is not None else quantiles(freq, num_cols, ps=FIVE_POINTS)
    cnt = (freq.where(F.col("num").isNotNull() & F.col("column_name").isin(num_cols))
           .groupBy("column_name").agg(F.sum("cnt").alias("_n")))
    q = q.join(F.broadcast(cnt), "column_name").where(F.col("_n") >= 3)
    names = F.array(F.lit("min"), F.lit("q1"), F.lit("median"), F.lit("q3"), F.lit("max"))
    pos = (F.col("p") * 4).cast("int")
    c = F.col("column_name")
    return _chart(q, ctype="boxplot", category="distribution", x_label=c, y_label=c, series=c, pos=pos,
                  label=F.element_at(names, pos + 1), y=safe("value", 4), **_texts("boxplot", c))


def frequency_charts(df: DataFrame, cat_cols: list[str], null_label: str | None = None) -> DataFrame:
    """Category frequency donut, ≥ 2 distinct values, top 10 incl. Others."""
    if not cat_cols:
        return None
    counts = category_counts(df, cat_cols, null_label)
    # distinct labels per column by aggregation (a window here would hold every
    # label of a column in one task); one row per categorical column is broadcast
    enough = counts.groupBy("cat_column").agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") >= 2)
    counts = counts.join(F.broadcast(enough.select("cat_column")), "cat_column", "left_semi")
    top = top_n_with_others(counts, ["cat_column"], PIE_TOP_N)
    c = F.col("cat_column")
    return _chart(top, ctype="donut", category="distribution", x_label=None, y_label=None, series="Count", pos=F.col("rank") - 1,
                  label=F.col("label"), y=F.col("value"), **_texts("frequency", c))


def _first_points(pairs: list[tuple[int, int]], order: list[str], points: int):
    """Keeps, in one pass over a task's rows, the first ``points`` complete rows of every pair of value columns."""
    def kept(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(order, na_position="first", kind="stable").head(points)

    def firsts(batches):
        held: dict[int, list[pd.DataFrame]] = {k: [] for k in range(len(pairs))}
        for pdf in batches:
            here = {c: pdf[c].notna().to_numpy() for c in pdf.columns if c not in order}
            for k, (i, j) in enumerate(pairs):
                both = here[f"_v{i}"] & here[f"_v{j}"]
                part = pdf.loc[both, [*order, f"_v{i}", f"_v{j}"]].set_axis([*order, "x", "y"], axis=1)
                held[k].append(kept(part))
                if len(held[k]) > 16:
                    held[k] = [kept(pd.concat(held[k]))]
        for k, parts in held.items():
            if parts:
                yield kept(pd.concat(parts)).assign(pair=k)

    return firsts


def _leaves(df: DataFrame, order: list[Column]) -> list[Column]:
    """Order columns without structs: their fields in turn."""
    out = []
    for c, field in zip(order, df.select(*order).schema.fields):
        if isinstance(field.dataType, T.StructType):
            out += [c.getField(f.name) for f in field.dataType.fields]
        else:
            out.append(c)
    return out


def scatter_charts(df: DataFrame, num_cols: list[str], order: list[Column],
                   points: int = SCATTER_POINTS) -> DataFrame:
    """First ``points`` complete rows (in row order) of every numeric pair, ≥ 3 rows.

    Every task looks at each row once, whatever the number of pairs, and sends at most
    ``points`` rows per pair, which are merged by order.
    """
    pairs = [(i, j) for i in range(len(num_cols)) for j in range(i + 1, len(num_cols))]
    if not pairs:
        return None
    ship_package(df.sparkSession)
    leaves = _leaves(df, order)
    names = [f"_o{i}" for i in range(len(leaves))]
    rows = df.select(*[c.alias(n) for c, n in zip(leaves, names)],
                     *[as_number(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"_v{i}") for i, c in enumerate(num_cols)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    first = rows.mapInPandas(_first_points(pairs, names, points), f"{kinds}, x double, y double, pair int")
    first = first.withColumn("_rk", F.row_number().over(Window.partitionBy("pair").orderBy(*names))).where(F.col("_rk") <= points)
    first = first.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("pair"))).where(F.col("_n") >= 3)
    named = F.array(*[F.struct(F.lit(num_cols[i]).alias("cx"), F.lit(num_cols[j]).alias("cy")) for i, j in pairs])
    first = first.withColumn("_names", F.element_at(named, F.col("pair") + 1))
    cx, cy = F.col("_names.cx"), F.col("_names.cy")
    texts = _texts("scatter", cx, cy)
    return _chart(first, ctype="scatter", category="correlation", x_label=cx, y_label=cy, series=texts["title"], pos=F.col("_rk") - 1,
                  x=safe("x", 4), y=safe("y", 4), **texts)


def heatmap_chart(corr_long: DataFrame, k: int) -> DataFrame:
    """Correlation triples (x index, y index, r), row-major in y."""
    return _chart(corr_long, ctype="heatmap", category="correlation", x_label=None, y_label=None, series="Correlation",
                  pos=F.col("pos_y") * F.lit(k) + F.col("pos_x"), label=F.concat(F.col("col_x"), F.lit(" / "), F.col("col_y")),
                  x=F.col("pos_x"), y=F.col("pos_y"), z=safe("r", 4), **_texts("heatmap"))


def chart_points(df: DataFrame, types_rows: list[dict], order: list[Column], corr_long: DataFrame | None = None,
                 freq: DataFrame | None = None, five: DataFrame | None = None) -> DataFrame:
    """All recommended charts of a table as one long table (families stacked).

    ``five`` are the ``quantiles`` at ``FIVE_POINTS`` of all its numeric columns, where they are known."""
    sets = chart_columns(types_rows)
    num, cat, dat = sets["numeric"], sets["categorical"], sets["date"]
    f = freq if freq is not None else frequency_table(df, num)
    parts = [trend_charts(df, dat, num), category_charts(df, cat, num), histogram_charts(f, num),
             boxplot_charts(df, f, num, five), frequency_charts(df, cat), scatter_charts(df, num, order)]
    if corr_long is not None and len(num) >= 2:
        parts.append(heatmap_chart(corr_long, len(num)))
    parts = [p for p in parts if p is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def custom_chart(df: DataFrame, x: str, y: str | None, chart_type: str = "bar", order: list[Column] | None = None,
                 limit_bar: int = 15, limit_pie: int = 10, limit_scatter: int = 300) -> DataFrame:
    """G11 (re-aimed to the whole filtered table): Σ y (or row count when y is
    missing or equals x) per x value, in first-seen row order; bar/line/area keep
    the first 15 labels (2 dp, blank key skipped); pie/donut the first 10 (null
    key → ``Unknown``); scatter the first 300 rows. Non-numeric y counts as 0."""
    order = order or []
    okey = F.struct(*order) if order else F.monotonically_increasing_id()
    count_mode = not y or y == x
    yv = F.lit(1.0) if count_mode else F.coalesce(as_number(F.col(f"`{y}`"), df.schema[y].dataType), F.lit(0.0))
    xt = value_text(F.col(f"`{x}`"), df.schema[x].dataType)
    title_y = "Count" if not y else y
    if chart_type == "scatter":
        xv = F.coalesce(as_number(F.col(f"`{x}`"), df.schema[x].dataType), F.lit(0.0))
        rows = df.select(okey.alias("_o"), xv.alias("_x"), yv.alias("_y")).orderBy("_o").limit(limit_scatter)
        rows = rows.withColumn("_p", F.row_number().over(Window.orderBy("_o")) - 1)
        return _chart(rows, F.lit(f"{x} vs {y}"), "scatter", "custom", x, y, f"{x} vs {y}",
                      F.col("_p"), None, F.col("_x"), F.col("_y"))
    if chart_type in ("pie", "donut"):
        key = F.coalesce(xt, F.lit("Unknown"))
        limit = limit_pie
        rnd = lambda c: F.col(c)
    else:
        key = F.when(xt != "", xt)
        limit = limit_bar
        rnd = lambda c: F.floor(F.col(c) * 100 + 0.5) / 100
    g = (df.select(key.alias("label"), yv.alias("_v"), okey.alias("_o")).where(F.col("label").isNotNull())
         .groupBy("label").agg(F.sum("_v").alias("_s"), F.min("_o").alias("_first")))
    # first-seen order: a per-task top-k on the first occurrence
    top = g.orderBy("_first").limit(limit)
    top = top.withColumn("_p", F.row_number().over(Window.orderBy("_first")) - 1)
    title = f"{title_y} {'by' if chart_type in ('pie', 'donut') else 'across'} {x}"
    return _chart(top, F.lit(title), chart_type, "custom", x, y, title_y, F.col("_p"), F.col("label"),
                  None, rnd("_s"))


def custom_boxplot(df: DataFrame, column: str) -> DataFrame:
    """Nearest-rank five numbers: sorted values at ⌊n·p⌋ (0-based), missing → 0."""
    v = F.coalesce(as_number(F.col(f"`{column}`"), df.schema[column].dataType), F.lit(0.0))
    vals = df.select(F.lit(column).alias("column_name"), v.alias("num"), F.lit(1).alias("cnt"))

    def ranks(n: Column) -> Column:
        return F.array(*[F.struct(F.lit(pos).alias("pos"), (n if p == 1.0 else F.floor(n * F.lit(p)) + 1).cast("bigint").alias("k"))
                         for pos, p in enumerate((0.0, 0.25, 0.5, 0.75, 1.0))])

    picked = order_statistics(vals, ["column_name"], ranks)
    names = F.array(F.lit("min"), F.lit("q1"), F.lit("median"), F.lit("q3"), F.lit("max"))
    return _chart(picked, F.lit(f"Boxplot of {column}"), "boxplot", "custom", None, column, column,
                  F.col("pos"), F.element_at(names, F.col("pos") + 1), None, F.col("value"))
