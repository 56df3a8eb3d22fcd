"""Pearson correlation over numeric columns, pairwise-complete.

One pass: every task keeps, for every pair of columns, the count, both means and the
central second moments of the rows in which both are present, so a huge value that
stands beside a missing one does not touch the pair. A batch is worked off by the
columns' null patterns: columns with the same nulls share one matrix product. Batches
and tasks are merged pairwise (Chan et al.): equal means have a difference of exactly
0, so a constant column keeps moments of exactly 0 (a correlation of 0, also on the
diagonal). A task sends one row per pair; they are folded in levels of ``FOLD`` tasks,
so no list is longer than that. Rows are never multiplied by pairs.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_number, fround

#: Rows of tasks merged at a time.
FOLD = 4096
_STATE = ("n", "mx", "my", "cxx", "cyy", "cxy")


def batch_state(x: np.ndarray) -> np.ndarray:
    """(6, columns, columns): count, means and central moments of every pair's complete rows; NaN is missing."""
    k = x.shape[1]
    state = np.zeros((6, k, k))
    here = ~np.isnan(x)
    patterns: dict[bytes, list[int]] = {}
    for c in range(k):
        patterns.setdefault(here[:, c].tobytes(), []).append(c)
    groups = list(patterns.values())
    for a in groups:
        for b in groups:
            rows = here[:, a[0]] & here[:, b[0]]
            n = np.count_nonzero(rows)
            if not n:
                continue
            left, right = x[np.ix_(rows, a)], x[np.ix_(rows, b)]
            # from the first row: exactly 0 where a column is constant
            first_l, first_r = left[0].copy(), right[0].copy()
            left, right = left - first_l, right - first_r
            mean_l, mean_r = left.mean(axis=0), right.mean(axis=0)
            left, right = left - mean_l, right - mean_r
            at = np.ix_(a, b)
            state[0][at] = n
            state[1][at] = (first_l + mean_l)[:, None]
            state[2][at] = (first_r + mean_r)[None, :]
            state[3][at] = (left * left).sum(axis=0)[:, None]
            state[4][at] = (right * right).sum(axis=0)[None, :]
            state[5][at] = left.T @ right
    return state


def merge_states(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """State of both sets of rows together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    weight = a[0] * share
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * weight,
                     a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight])


def _task_states(n_columns: int):
    i, j = np.triu_indices(n_columns)

    def summed(batches):
        from pyspark import TaskContext
        state = np.zeros((6, n_columns, n_columns))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], axis=1)
            state = merge_states(state, batch_state(x))
        seen = state[0][i, j] > 0
        task = np.full(int(seen.sum()), TaskContext.get().partitionId(), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(task), pa.array(i[seen].astype(np.int32)), pa.array(j[seen].astype(np.int32)),
             *[pa.array(s[i, j][seen]) for s in state]], ["task", "pos_x", "pos_y", *_STATE])

    return summed


def _merged(a, b):
    """The columns' counterpart of ``merge_states`` for two structs of states."""
    n = a["n"] + b["n"]
    share = b["n"] / n
    dx, dy, weight = b["mx"] - a["mx"], b["my"] - a["my"], a["n"] * share
    return F.struct(n.alias("n"), (a["mx"] + dx * share).alias("mx"), (a["my"] + dy * share).alias("my"),
                    (a["cxx"] + b["cxx"] + dx * dx * weight).alias("cxx"),
                    (a["cyy"] + b["cyy"] + dy * dy * weight).alias("cyy"),
                    (a["cxy"] + b["cxy"] + dx * dy * weight).alias("cxy"))


def _folded(states: DataFrame, tasks: int) -> DataFrame:
    """One state per pair: the rows of up to FOLD tasks are merged in the order of the tasks, level by level."""
    nothing = F.struct(*[F.lit(0.0).alias(c) for c in _STATE])
    while True:
        listed = F.sort_array(F.collect_list(F.struct("task", F.struct(*_STATE).alias("s"))))
        states = states.groupBy("pos_x", "pos_y", F.floor(F.col("task") / FOLD).alias("task")).agg(
            F.aggregate(listed, nothing, lambda acc, e: _merged(acc, e["s"])).alias("s"))
        states = states.select("task", "pos_x", "pos_y", "s.*")
        if tasks <= FOLD:
            return states
        tasks = -(-tasks // FOLD)


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(col_x, col_y, pos_x, pos_y, r)`` for every ordered pair, diagonal
    included; empty when fewer than two columns."""
    from ..session import ship_package
    spark = df.sparkSession
    schema = "col_x string, col_y string, pos_x int, pos_y int, r double"
    if len(columns) < 2:
        return spark.createDataFrame([], schema)
    ship_package(spark)
    views = [as_number(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns]
    base = df.select(*[v.alias(f"_v{i}") for i, v in enumerate(views)])
    kinds = ", ".join(f"{c} double" for c in _STATE)
    states = base.mapInArrow(_task_states(len(columns)), f"task bigint, pos_x int, pos_y int, {kinds}")
    # two levels: enough for FOLD squared tasks, more than a job can have
    sums = _folded(states, FOLD ** 2)
    pairs = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos_x"), F.lit(j).alias("pos_y")) for i in range(len(columns)) for j in range(i, len(columns))])).alias("p"))
    sums = pairs.select("p.*").join(sums, ["pos_x", "pos_y"], "left")
    r = F.try_divide(F.col("cxy"), F.sqrt("cxx") * F.sqrt("cyy"))
    upper = sums.select("pos_x", "pos_y", F.when((F.col("n") > 1) & r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))).alias("r"))
    val = F.coalesce(F.nanvl(F.col("r"), F.lit(None).cast("double")), F.lit(0.0))
    mirrored = F.when(F.col("pos_x") != F.col("pos_y"),
                      F.struct(F.col("pos_y").alias("pos_x"), F.col("pos_x").alias("pos_y"), val.alias("r")))
    both = F.array(F.struct(F.col("pos_x").alias("pos_x"), F.col("pos_y").alias("pos_y"), val.alias("r")), mirrored)
    long = upper.select(F.inline(F.filter(both, lambda e: e.isNotNull())))
    names = F.array(*[F.lit(c) for c in columns])
    return long.select(F.element_at(names, F.col("pos_x") + 1).alias("col_x"),
                       F.element_at(names, F.col("pos_y") + 1).alias("col_y"),
                       F.col("pos_x").cast("int").alias("pos_x"), F.col("pos_y").cast("int").alias("pos_y"),
                       fround(F.col("r"), 4).alias("r"))


def correlation_matrix(long: DataFrame, columns: list[str]) -> DataFrame:
    """Square form: one row per ``col_x`` and one column per name (pivot)."""
    return long.groupBy("col_x", "pos_x").pivot("col_y", list(columns)).agg(F.first("r"))
