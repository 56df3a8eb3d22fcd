"""Scanning delimited text and typed tables into raw grids.

The encoding, the separator, whether quoted cells hold line ends and the width of the
grid come from one pass over all lines of all files (``records.block_facts``),
which knows for every byte whether it stands in a quoted cell. Files are then grouped by
(encoding, separator, line ends in cells). A group without line ends in cells is one CSV
scan; in the others records are put together block by block and parsed one by
one. Both are splittable. Row order is carried explicitly as ``_row_ord = struct(block,
row)``, which is file order within each file even when a file is split across tasks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CSV_NA_TOKENS
from ..operators.clean import na_to_null
from ..session import scratch_path
from . import records as rec

SEPARATORS = list(rec.SEPARATORS)


def _open_prefix(path: str, nbytes: int) -> bytes:
    import pyarrow.fs as pafs
    if path.startswith("file:"):
        local = path[len("file:"):]
        while local.startswith("//"):
            local = local[1:]
        fs, p = pafs.LocalFileSystem(), local
    else:
        fs, p = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(p) as fh:
        return fh.read(nbytes)


def _states(spark: SparkSession, paths, seps: list[str]) -> DataFrame:
    """The states of all blocks for the candidate separators."""
    path = scratch_path(spark, "block-facts")
    rec.block_facts(spark, paths, tuple(seps)).write.parquet(path)  # a few rows per block
    return rec.block_states(spark.read.parquet(path))


def _sniffed(spark: SparkSession, paths, states: DataFrame, seps: list[str]) -> DataFrame:
    """The best separator of every file with its facts: ``(_file, file, cand, sep, encoding, multi, width)``."""
    facts = rec.file_facts(states, len(seps)).join(rec.best_separators(states, len(seps)), ["file", "cand"])
    names = list_files(spark, paths).select(F.col("path").alias("_file"), F.xxhash64("path").alias("file"))
    return facts.join(names, "file").select(
        "_file", "file", "cand", F.element_at(F.array(*[F.lit(s) for s in seps]), F.col("cand") + 1).alias("sep"),
        F.when(F.col("bad"), "ISO-8859-1").otherwise("UTF-8").alias("encoding"),
        # a quoted cell that is never closed: every line is a record
        (F.col("multi") & F.col("closed")).alias("multi"), "width")


def sniff_files(spark: SparkSession, paths, sep: str | None = None) -> DataFrame:
    """S2 and S3 per file over all its lines: ``(_file, encoding, sep, width, multi)``. Encoding: latin-1 if any
    line is not valid UTF-8; width: the cells of the widest record; multi: quoted cells hold line ends."""
    seps = [sep] if sep else SEPARATORS
    return _sniffed(spark, paths, _states(spark, paths, seps), seps).select("_file", "encoding", "sep", "width", "multi")


def _options(sep: str) -> dict:
    return {"header": "false", "sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _schema(width: int) -> str:
    return ", ".join(f"c{i} string" for i in range(width))


def _lines_scan(spark: SparkSession, files, encoding: str, sep: str, width: int) -> DataFrame:
    """Files without line ends in cells: one splittable CSV scan."""
    scan = spark.read.schema(_schema(width)).options(**_options(sep)).option("encoding", encoding).csv(files)
    return scan.select(F.col("_metadata.file_path").alias("_file"),
                       F.struct(F.col("_metadata.file_block_start").alias("block"),
                                F.monotonically_increasing_id().alias("row")).alias("_row_ord"), *_cells(width))


def _records_scan(spark: SparkSession, files: list, encoding: str, sep: str, width: int, states: DataFrame, names: DataFrame) -> DataFrame:
    """Files with line ends in cells: records put together by blocks, then parsed one by one."""
    found = rec.records(spark, files, sep, states)
    parsed = F.from_csv(F.decode("record", encoding), _schema(width), {**_options(sep), "multiLine": "true"})
    return (found.join(F.broadcast(names), "file")  # one row per file of the group, as in the list that is scanned
            .select("_file", F.struct("block", "row").alias("_row_ord"), parsed.alias("_r")).select("_file", "_row_ord", "_r.*"))


def _cells(width: int) -> list:
    return [F.col(f"c{i}") for i in range(width)]


def read_delimited(spark: SparkSession, paths, sep: str | None = None, encoding: str | None = None,
                   width: int | None = None, na_tokens=CSV_NA_TOKENS) -> DataFrame:
    """Headerless all-text scan → raw grid ``(_file, _row_ord, c0 … cN)``.

    Without ``sep``/``encoding`` each file's are found (see ``sniff_files``; the answers
    are collected, one row per file, as the scans' file lists are). Without
    ``width`` the grid is as wide as the widest record. Missing-value tokens become NULL (S4).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    seps = [sep] if sep else SEPARATORS
    states = _states(spark, paths, seps)
    sniffed = _sniffed(spark, paths, states, seps).collect()
    groups: dict = {}
    for r in sniffed:
        groups.setdefault((encoding or r["encoding"], r["sep"], r["cand"], r["multi"]), []).append((r["_file"], r["file"]))
    w = width or max([r["width"] for r in sniffed] or [1])
    if not groups:
        groups = {(encoding or "UTF-8", sep or ",", 0, False): []}
    parts = []
    for (enc, sp, cand, multi), files in groups.items():
        # one group alone: the paths as they were given
        scanned = [f for f, _ in files] if len(groups) > 1 else paths
        if multi:
            names = spark.createDataFrame(files, "_file string, file bigint")
            parts.append(_records_scan(spark, scanned, enc, sp, w, states.where(F.col("cand") == cand), names))
        else:
            parts.append(_lines_scan(spark, scanned, enc, sp, w))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # a byte-order mark stays glued to the first cell of a UTF-8 file
    out = out.withColumn("c0", F.regexp_replace("c0", "^﻿", ""))
    return na_to_null(out, na_tokens)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A typed table; NaN in floating columns is treated as missing downstream."""
    return spark.read.format(fmt).load(path)


def _listing(spark: SparkSession, paths) -> DataFrame:
    """A file scan of everything under the paths (globs allowed) that opens no file unless its content is asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)


def list_files(spark: SparkSession, paths) -> DataFrame:
    """``(path, length)`` of every file that is not empty under the paths."""
    return _listing(spark, paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"))


def inspect_sources(spark: SparkSession, paths, max_bytes: int | None = None) -> DataFrame:
    """``(path, extension, size_bytes, status, reason)`` per file.

    Checks extension, emptiness, size cap and magic bytes (ZIP for .xlsx, OLE
    for .xls), of which only the first four bytes are read.
    """
    from ..functions.constants import MAX_UPLOAD_BYTES
    cap = MAX_UPLOAD_BYTES if max_bytes is None else max_bytes
    # scans leave empty files out; the scan's own file list has them
    key = F.regexp_replace("path", "^file:/+", "file:/").alias("path")  # lists and scans write it differently
    names = spark.createDataFrame([(f,) for f in _listing(spark, paths).inputFiles()], "path string").select(key)
    sizes = list_files(spark, paths).select(key, "length")
    meta = names.join(sizes, "path", "left").select("path", F.coalesce("length", F.lit(0)).cast("bigint").alias("length"))

    def first_bytes(batches):
        import pandas as pd
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "magic": [_open_prefix(p, 4).hex().upper() for p in pdf["path"]]})

    from ..session import ship_package
    ship_package(spark)
    small = meta.where(F.col("length") > 0).select("path").mapInPandas(first_bytes, "path string, magic string")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    df = meta.join(small, "path", "left").select("path", ext.alias("extension"),
                                                 F.col("length").alias("size_bytes"), "magic")
    reason = (F.when(~F.col("extension").isin("csv", "xls", "xlsx"), "Unsupported file format")
              .when(F.col("size_bytes") == 0, "The file is empty")
              .when(F.col("size_bytes") > cap, "File exceeds the size limit")
              .when((F.col("extension") == "xlsx") & (F.col("magic") != "504B0304"), "Missing ZIP header")
              .when((F.col("extension") == "xls") & (F.col("magic") != "D0CF11E0"), "Missing OLE header"))
    return df.select("path", "extension", "size_bytes",
                     F.when(reason.isNull(), "ok").otherwise("rejected").alias("status"), reason.alias("reason"))
