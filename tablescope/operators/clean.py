"""Turning a raw all-text grid into a typed table.

A raw grid is ``(_file, _row_ord, c0 … cN)`` with every cell STRING and
``_row_ord`` a struct (block, row) in file order, its rows numbered without gaps within a
block. Header detection looks only at the first 31 rows of each file, which the number of
rows and the first number of each block tell; no row is sorted for it.
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean_text, is_date_text, is_total_row, to_number, to_timestamp_mixed
from ..functions.constants import HEADER_KEYWORDS, HEADER_NUMBER_STRIP_PATTERN, HEADER_SCAN_ROWS
from .types import collect_types, column_types

ORDER_COLS = ["_file", "_row_ord"]


def data_columns(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if not c.startswith("_")]


def _is_pure_number(v: Column) -> Column:
    """Header-scorer number test (Python ``float`` after stripping , $ € £ %)."""
    t = F.trim(F.regexp_replace(v, HEADER_NUMBER_STRIP_PATTERN, ""))
    special = F.lower(t).isin("nan", "+nan", "-nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")
    return t.rlike(r"^[+-]?([0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)([eE][+-]?[0-9]+)?$") | special


def head_rows(raw: DataFrame, scan_rows: int = HEADER_SCAN_ROWS) -> DataFrame:
    """The first ``scan_rows + 1`` rows of every file with their rank ``_rn``."""
    block, row = F.col("_row_ord.block"), F.col("_row_ord.row")
    blocks = raw.groupBy(F.col("_file").alias("_f"), block.alias("_b")).agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the blocks in which a file's first rows lie: one per file as a rule
    starts = blocks.withColumn("_before", before).where(F.col("_before") <= scan_rows).drop("_n")
    place = row - F.col("_first") + F.col("_before") + 1
    found = raw.join(F.broadcast(starts), (F.col("_file") == F.col("_f")) & (block == F.col("_b")))
    return found.withColumn("_rn", place.cast("int")).where(F.col("_rn") <= scan_rows + 1).drop("_f", "_b", "_first", "_before")


def header_scores(raw: DataFrame, scan_rows: int = HEADER_SCAN_ROWS, head: DataFrame | None = None) -> DataFrame:
    """Score of every candidate row ``(_file, _rn, _row_ord, score)``; rows that
    do not qualify are absent."""
    cols = data_columns(raw)
    max_cols = len(cols)
    head = head if head is not None else head_rows(raw, scan_rows)
    cells = head.select("_file", "_rn", "_row_ord",
                        F.posexplode(F.array(*[F.col(f"`{c}`") for c in cols])).alias("_pos", "_v"))
    v = F.trim(F.col("_v"))
    filled = F.col("_v").isNotNull()
    nonblank = filled & (v != "")
    is_data = _is_pure_number(v) | is_date_text(v)
    string_cell = nonblank & ~is_data & (F.length(v) < 50)
    per_row = cells.groupBy("_file", "_rn", "_row_ord").agg(
        F.count("_v").alias("_nn"),
        F.sum(F.when(string_cell, 1).otherwise(0)).alias("_strings"),
        F.collect_set(F.when(string_cell, F.lower(v))).alias("_uniq"),
        F.sum(F.when(filled & (is_data | (F.length(v) < 30)), 1).otherwise(0)).alias("_data_cells"),
    )
    kw = F.array(*[F.lit(k) for k in HEADER_KEYWORDS])
    matched = F.size(F.filter("_uniq", lambda s: F.exists(kw, lambda k: s.contains(k))))
    scored = per_row.withColumn("_bonus", F.lead("_data_cells").over(Window.partitionBy("_file").orderBy("_rn")))
    scored = scored.withColumn("score", F.size("_uniq") * 15.0 + F.col("_nn") * 5.0 + matched * 20.0
                               + F.when(F.col("_bonus") >= 2, 30.0).otherwise(0.0))
    ok = (F.col("_rn") <= scan_rows) & (F.col("_nn") > 0) & ~((F.col("_nn") < 2) & F.lit(max_cols >= 3)) \
        & (F.col("_strings") > 0)
    return scored.where(ok).select("_file", "_rn", "_row_ord", "score")


def detect_header_row(raw: DataFrame, scan_rows: int = HEADER_SCAN_ROWS) -> DataFrame:
    """``(_file, header_rn, header_ord, cells)``: the best-scoring row per file
    (first maximum wins) and its trimmed cells; files where no row qualifies use their first row."""
    # at most scan_rows + 1 rows of a file, read twice
    head = head_rows(raw, scan_rows).persist(StorageLevel.MEMORY_AND_DISK)
    sc = header_scores(raw, scan_rows, head)
    best = sc.groupBy("_file").agg(F.max_by("_rn", F.struct(F.col("score"), -F.col("_rn"))).alias("_best"))
    cells = F.array(*[F.trim(F.col(f"`{c}`")) for c in data_columns(raw)])
    rows = head.select("_file", "_rn", "_row_ord", cells.alias("cells"))
    return (rows.join(best, "_file", "left").where(F.col("_rn") == F.coalesce("_best", F.lit(1)))
            .select("_file", F.col("_rn").alias("header_rn"), F.col("_row_ord").alias("header_ord"), "cells"))


def normalize_column_names(names: list) -> list[str]:
    """Trim; blank / ``Unnamed:*`` / ``nan`` → ``Column_{i}``; repeats → ``name_k``,
    always unique (generated names are checked too)."""
    out, used = [], set()
    seen: dict[str, int] = {}
    for i, raw_name in enumerate(names):
        name = "" if raw_name is None else str(raw_name).strip()
        if not name or name.startswith("Unnamed:") or name == "nan":
            name = f"Column_{i + 1}"
        k = seen.get(name, 0)
        cand = name if k == 0 else f"{name}_{k + 1}"
        while cand in used:
            k += 1
            cand = f"{name}_{k + 1}"
        seen[name] = k + 1
        used.add(cand)
        out.append(cand)
    return out


def _named(cells: list) -> list[str]:
    """Column names of a header row; blank ones become ``Column_{i}``."""
    out = []
    for i, val in enumerate(cells):
        s = "" if val is None else str(val).strip()
        out.append(s if s and s != "nan" else f"Column_{i + 1}")
    return out


def promote_header(raw: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """Keep the rows below each file's own header row and name their cells by it.

    Files with the same header cells form a layout. Each layout's
    names are made unique and the layouts are matched by name; columns stand in
    the order of the first file's layout, then of the others', and a column that a
    layout lacks is NULL there.
    """
    cols = data_columns(raw)
    # one row per file, used for the layouts and again for the rows: broadcast, so that a file's rows stay where they were read
    header = (header if header is not None else detect_header_row(raw)).persist(StorageLevel.MEMORY_AND_DISK)
    # one row per layout
    layouts = header.groupBy("cells").agg(F.min("_file").alias("_first")).orderBy("_first").collect()
    if len(layouts) <= 1:
        body = raw.join(F.broadcast(header.select("_file", "header_ord")), "_file").where(F.col("_row_ord") > F.col("header_ord"))
        given = _named(list(layouts[0]["cells"]) if layouts else [None] * len(cols))
        # unique from here on; what the header says stays with the column until empty ones are dropped
        return body.select("_file", "_row_ord", *[F.col(f"`{c}`").alias(n, metadata={"header": g})
                                                  for c, n, g in zip(cols, normalize_column_names(given), given)])
    of_layout = [normalize_column_names(_named(list(r["cells"]))) for r in layouts]
    names = list(dict.fromkeys(n for own in of_layout for n in own))
    # where each output column stands in a layout, -1 where it has none
    places = [[own.index(n) if n in own else -1 for n in names] for own in of_layout]
    # null cells: compared as text with a mark of their own
    key = lambda c: F.array_join(c, "\x1f", "\x00")
    known = raw.sparkSession.createDataFrame([(list(r["cells"]), p) for r, p in zip(layouts, places)],
                                             "_cells array<string>, _places array<int>")
    files = header.select("_file", "header_ord", key("cells").alias("_k")).join(
        F.broadcast(known.select(key("_cells").alias("_k"), "_places")), "_k").drop("_k")
    body = raw.join(F.broadcast(files), "_file").where(F.col("_row_ord") > F.col("header_ord"))
    body = body.select("_file", "_row_ord", F.array(*[F.col(f"`{c}`") for c in cols]).alias("_row"), "_places")
    return body.select("_file", "_row_ord", *[F.get("_row", F.get("_places", F.lit(i))).alias(n) for i, n in enumerate(names)])


def drop_empty(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Drop all-null rows, then all-null columns (one aggregate)."""
    cols = [c for c in df.columns if not c.startswith("_")]
    keep = [c for c in df.columns if c.startswith("_")] if keep is None else keep
    rows = df.dropna(how="all", subset=cols) if cols else df
    counts = rows.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    nonempty = [c for i, c in enumerate(cols) if counts[f"n{i}"] > 0]
    return rows.select(*[F.col(c) for c in keep], *[F.col(f"`{c}`") for c in nonempty])


def drop_total_rows(df: DataFrame) -> DataFrame:
    """C4: drop rows whose first three filled cells include a total/footer label."""
    cols = [F.col(f"`{c}`") for c in df.columns if not c.startswith("_")]
    return df.where(~F.coalesce(is_total_row(cols), F.lit(False)))


def coerce_columns(df: DataFrame, types_rows: list[dict]) -> DataFrame:
    """Numbers → DOUBLE (BIGINT for Integer), dates → TIMESTAMP, text trimmed
    with blanks and spreadsheet errors → NULL. ``try_*`` expressions cannot
    fail, so one bad cell never stops a column."""
    by_name = {t["column_name"]: t for t in types_rows}
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        t = by_name.get(c)
        if c.startswith("_") or t is None:
            out.append(col)
        elif t["is_numeric"]:
            num = to_number(col)
            out.append((num.cast("bigint") if t["detected_type"] == "Integer" else num).alias(c))
        elif t["is_date"]:
            out.append(to_timestamp_mixed(col).alias(c))
        else:
            out.append(clean_text(col).alias(c))
    return df.select(*out)


def na_to_null(df: DataFrame, tokens: list[str]) -> DataFrame:
    """Missing-value tokens → NULL in every data column, one ``select``."""
    return df.select(*[F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(c)
                       if not c.startswith("_") else F.col(c) for c in df.columns])


def clean_table(raw: DataFrame, keep_order: bool = False) -> DataFrame:
    """C11 = C1 → C2 → C3 → C4 → C5 → C9 → C10 on a raw grid."""
    # parsed once: the emptiness counts, the type pass and the coercion all
    # read the promoted body (memory, spilling to disk; lost blocks re-parse)
    promoted = promote_header(raw).persist(StorageLevel.MEMORY_AND_DISK)
    trimmed = drop_empty(promoted)
    body = drop_total_rows(trimmed)
    data = [c for c in body.columns if not c.startswith("_")]
    names = normalize_column_names([body.schema[c].metadata.get("header", c) for c in data])
    body = body.select(*[F.col(c) for c in ORDER_COLS],
                       *[F.col(f"`{c}`").alias(n) for c, n in zip(data, names)])
    types = collect_types(column_types(body, names))
    typed = coerce_columns(body, types)
    typed = typed.dropna(how="all", subset=names)
    return typed if keep_order else typed.drop(*ORDER_COLS)
