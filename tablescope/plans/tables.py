"""Loading the driver's parquet tables and profiling helpers shared by queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_reduces, small_splits
from ..sources.delimited import list_files

#: A table below it may be too few splits to be shared out by the scan alone (a row group is never split).
SPLIT_BYTES = 128 << 20
#: Bytes of a slice of such a table: some 200,000 rows of the driver's tables.
SLICE_BYTES = 2 << 20


def slices(size: int, slots: int) -> int:
    """Into how many slices a table of ``size`` bytes is dealt: one per task slot, more where these would be large."""
    return max(slots, -(-size // SLICE_BYTES))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's parquet table. One that is smaller than a split would be one task of every
    scan: it is dealt out over the task slots, in slices that do not grow with it. A larger one is read in small splits.
    What a reduce task reads is held small as well."""
    small_splits(spark)
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    size = list_files(spark, path).agg(F.sum("length").alias("b")).first()["b"] or 0
    small_reduces(spark, size)
    return df.repartition(slices(size, spark.sparkContext.defaultParallelism)) if size < SPLIT_BYTES else df


def with_nulls(df: DataFrame, spec: dict[str, "F.Column"]) -> DataFrame:
    """Derive missing values: each column becomes NULL where its condition holds."""
    return df.select(*[F.when(~spec[c], F.col(c)).alias(c) if c in spec else F.col(c) for c in df.columns])
