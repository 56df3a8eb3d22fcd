"""CSV export, JSON-safe records."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso_text(ts, separator: str):
    """ISO-8601 text of a timestamp; the fraction of a second is written where it is not zero."""
    t = ts.cast("timestamp")
    whole = F.date_format(t, f"yyyy-MM-dd'{separator}'HH:mm:ss")
    micros = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    return F.when(micros == 0, whole).otherwise(F.concat(whole, F.lit("."), F.lpad(micros.cast("string"), 6, "0")))


def timestamps_as_text(df: DataFrame, separator: str) -> DataFrame:
    """Timestamp columns as ISO text, the others as they are."""
    return df.select(*[
        iso_text(F.col(f"`{f.name}`"), separator).alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header row, no index, UTF-8; one part file per task (no byte-order mark)."""
    timestamps_as_text(df, " ").write.mode(mode).option("header", True).option("escape", '"').csv(path)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN / ±Infinity → NULL in floating columns."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c).alias(f.name)
        out.append(c)
    return df.select(*out)


def to_records(df: DataFrame, max_rows: int | None = None, order=None) -> DataFrame:
    """One JSON object per row (``record``); NaN/Inf → null, timestamps ISO-8601,
    null fields kept."""
    base = df.orderBy(*order) if order else df
    if max_rows:
        base = base.limit(max_rows)
    safe = timestamps_as_text(json_safe(base), "T")
    cols = [F.col(f"`{c}`") for c in safe.columns]
    return safe.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false",
                                                    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss",
                                                    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("record"))
