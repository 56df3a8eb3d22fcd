"""Plan-shape regressions: pushdown, top-k before the shuffle, Expand-based unpivot."""
import contextlib
import io

from tablescope.operators.filters import apply_filters
from tablescope.operators.freq import frequency_table
from tablescope.operators.profile import top_values

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_range_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    out = apply_filters(df, {"numeric_ranges": {"o_totalprice": {"min": 1000}},
                             "date_ranges": {"o_orderdate": {"start": "1996-01-01"}},
                             "category_filters": {"o_orderstatus": ["F"]}})
    pushed = [l for l in _plan(out).splitlines() if "PushedFilters" in l][0]
    assert "GreaterThanOrEqual(o_totalprice" in pushed and "GreaterThanOrEqual(o_orderdate" in pushed
    assert "o_orderstatus" in pushed


def test_top_values_limit_before_shuffle_and_expand(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    p = _plan(top_values(frequency_table(df)))
    assert "Expand" in p and "Generate" not in p
    assert p.count("WindowGroupLimit") >= 2  # partial (map side) and final


def test_tables_are_read_in_slices_that_do_not_grow(spark, tmp_dir):
    """A task of a scan gets a bounded part of a table: its hash aggregate then holds a bounded number of cells."""
    from tablescope.plans.tables import SLICE_BYTES, SPLIT_BYTES, load, slices
    from tablescope.session import SCAN_BYTES
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.range(1000).write.parquet(f"{tmp_dir}/t.parquet")
    try:
        spark.conf.set(name, "128MB")
        load(spark, tmp_dir, "t")
        assert int(spark.conf.get(name)) == SCAN_BYTES
        spark.conf.set(name, "1m")
        assert load(spark, tmp_dir, "t").count() == 1000 and spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)
    assert slices(0, 12) == slices(12 * SLICE_BYTES, 12) == 12 and slices(SPLIT_BYTES, 12) == SPLIT_BYTES // SLICE_BYTES


def test_reduce_tasks_read_little_however_large_the_table(spark):
    """What adaptive execution puts together for a task, and the partitions it starts from, follow the table."""
    from tablescope.session import MOST_PARTITIONS, REDUCE_BYTES, small_reduces
    read, number = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before, start = spark.conf.get(read), spark.conf.get(number, None)
    try:
        spark.conf.set(read, "64MB")
        spark.conf.set(number, "8")
        small_reduces(spark, 1 << 20)
        assert int(spark.conf.get(read)) == REDUCE_BYTES and spark.conf.get(number) == "8"
        spark.conf.set(read, "1m")
        small_reduces(spark, 20 * REDUCE_BYTES)
        assert spark.conf.get(read) == "1m" and int(spark.conf.get(number)) == 80
        small_reduces(spark, 1 << 40)
        assert int(spark.conf.get(number)) == MOST_PARTITIONS
        spark.conf.set(number, "500")
        small_reduces(spark, 1 << 40)
        assert spark.conf.get(number) == "500"
    finally:
        spark.conf.set(read, before)
        spark.conf.unset(number) if start is None else spark.conf.set(number, start)
