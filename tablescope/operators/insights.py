"""Rule-based insights over the profile tables (all inputs are small:
one row, or one row per column / column pair)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import filled, fround, py_float_text
from ..functions.constants import INSIGHT_TEXTS, MAX_INSIGHTS


def _thousands(c):
    return F.format_number(c.cast("double"), 0)


def _row(df: DataFrame, rule: int, typ, severity, text: str, **parts) -> DataFrame:
    lit = lambda v: v if not isinstance(v, str) else F.lit(v)
    title, description = INSIGHT_TEXTS[text]
    return df.select(F.lit(rule).alias("_rule"), lit(typ).alias("type"), lit(severity).alias("severity"),
                     filled(title, **parts).alias("title"), filled(description, **parts).alias("description"))


def insights(summary: DataFrame, column_stats: DataFrame, correlation_long: DataFrame | None,
             top_first: DataFrame) -> DataFrame:
    """``(ord, type, severity, title, description)``, first six in rule order.

    summary: one row (total_rows, missing_percentage, duplicate_rows);
    column_stats: (column_name, pos, total_rows, null_percentage, outliers_count) with
    NULL outliers for columns without numeric stats;
    correlation_long: (col_x, col_y, pos_x, pos_y, r) or None;
    top_first: (column_name, pos, value, percentage) = top value of each
    categorical column.
    """
    mp, dup, rows = F.col("missing_percentage"), F.col("duplicate_rows"), F.col("total_rows")
    quality = F.when((mp < 2) & (dup == 0), "excellent").when(mp < 10, "good").otherwise("attention")
    i1 = _row(summary, 1, "summary", F.when(quality == "attention", "warning").otherwise("info"), "summary",
              quality=quality, rows=_thousands(rows), missing=py_float_text(mp), duplicates=_thousands(dup))
    i2 = _row(summary.where(dup > 0), 2, "quality", "warning", "duplicates", duplicates=_thousands(dup))
    miss = (column_stats.where(F.col("null_percentage") >= 20)
            .agg(F.sort_array(F.collect_list(F.struct("pos", F.concat(
                F.col("column_name"), F.lit(" ("), py_float_text(F.col("null_percentage")), F.lit("%)"))
                .alias("t")))).alias("a"))
            .where(F.size("a") > 0))
    i3 = _row(miss, 3, "quality", "warning", "missing", columns=F.array_join(F.transform(F.slice("a", 1, 5), lambda s: s["t"]), ", "))
    parts = [i1, i2, i3]
    if correlation_long is not None:
        strong = (correlation_long.where((F.col("pos_x") < F.col("pos_y")) & (F.abs("r") >= 0.7))
                  .agg(F.max_by(F.struct("col_x", "col_y", "r"),
                                F.struct(F.abs("r"), -F.col("pos_x"), -F.col("pos_y"))).alias("b"))
                  .where(F.col("b").isNotNull()))
        direction = F.when(F.col("b.r") > 0, "positive").otherwise("negative")
        parts.append(_row(strong, 4, "correlation", "success", "correlation", direction=direction, x=F.col("b.col_x"), y=F.col("b.col_y"),
                          r=F.format_string("%.2f", F.col("b.r"))))
    out_pct = fround(F.col("outliers_count") / F.greatest(F.col("total_rows"), F.lit(1)) * 100, 1)
    outl = column_stats
    outl = (outl.where((F.col("outliers_count") > 0) & (out_pct >= 3))
            .agg(F.min_by(F.struct("column_name", "outliers_count"), F.col("pos")).alias("o"))
            .where(F.col("o").isNotNull()))
    parts.append(_row(outl, 5, "outlier", "warning", "outliers", x=F.col("o.column_name"), n=_thousands(F.col("o.outliers_count"))))
    dom = (top_first.where(F.col("percentage") >= 40)
           .agg(F.min_by(F.struct("column_name", "value", "percentage"), F.col("pos")).alias("d"))
           .where(F.col("d").isNotNull()))
    parts.append(_row(dom, 6, "distribution", "info", "dominant", x=F.col("d.column_name"), value=F.col("d.value"),
                      share=py_float_text(F.col("d.percentage"))))
    allrows = parts[0]
    for p in parts[1:]:
        allrows = allrows.unionByName(p)
    # at most six rows: a window without partition is bounded here
    ranked = allrows.withColumn("ord", F.row_number().over(Window.orderBy("_rule")) - 1)
    return ranked.where(F.col("ord") < MAX_INSIGHTS).select(F.col("ord").cast("int").alias("ord"),
                                                            "type", "severity", "title", "description")
