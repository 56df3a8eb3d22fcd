"""Helpers shared by the training-data operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablescope.session import ensure_checkpoint_dir, scratch_path, ship_package

#: White space that separates words, as trim characters and as a regular expression.
SPACES = " \t\n\x0b\f\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Make the session ready: UTC, a shared checkpoint folder, the package on the workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder; cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet (case-insensitively), one for each of ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new, n = f"_{name}", 0
        while new.lower() in taken:
            n += 1
            new = f"_{name}_{n}"
        taken.add(new.lower())
        out.append(new)
    return out


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_PATTERN))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return id_crc(doc_id) % mod == rest


#: At most so many keys count as hot in ``join_hot``: those with over 1/HOT of the rows.
HOT = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Join (inner or left) on ``key``, of which ``left`` may have very many rows and ``right`` has one at most.

    Keys with more than 1/HOT of the rows of ``left``, so HOT at most, are joined by
    broadcast; the rest by a shuffle, in which no key is large.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    row = left.agg(F.count("*").alias("n")).first()
    hot = written(counts.where((F.col("_n") > row["n"] // HOT) & (F.col("_n") > 1)).select(key), "hot-keys")
    few, rest = right.join(F.broadcast(hot), key, "left_semi"), right.join(F.broadcast(hot), key, "left_anti")
    return left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how).unionByName(
        left.join(F.broadcast(hot), key, "left_anti").join(rest, key, how))
