"""Mixing sources to target weights by weighted fair queueing.

A source's target is its weight's share of the token budget, held at ``EPOCHS``
times its size, the excess shared by weight among the others (water filling).
Every document, in an order shuffled by the md5 of its id, gets a virtual finish
time: cumulative tokens of its source divided by the source's target; its
repeat follows a whole source size later. All copies are range-sorted by finish
time and the sequence is cut where its tokens reach the total budget.

No source is ever gathered in one task: running sums are taken over small,
hash-ordered buckets whose number follows the source's rows, then over the
buckets' totals; the global cut is found in a histogram of finish times, and
only the bucket that holds the cut is sorted. Only tables with a row per source
or per histogram cell are small enough to be swept by one task, and they are.

Edge cases: a null text has size 0; a null source is a source of its own and
sorts last; repeated rows count each on its own, ties are broken by size and the text's digest;
an empty table gives an empty result; other columns are ignored by ``taken`` and
kept by ``mix``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import fresh, prepare, words, written

WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
EPOCHS = 2
BUCKET_ROWS = 1_000
CELLS = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE,
            epochs: int = EPOCHS) -> DataFrame:
    """(source, source_rank, rows, source_size, weight, target, budget) from (source, rows, source_size); one row per source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("source_rank", place).withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    every = W.partitionBy()
    full = (W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
            .rowsBetween(W.unboundedPreceding, -1))
    # in the order of cap / weight the held sources come first; a source is held if the level that would
    # be left for it and all after it is not below its own
    level = ((F.col("budget") - F.coalesce(F.sum("cap").over(full), F.lit(0)))
             / (F.col("all_weight") - F.coalesce(F.sum("weight").over(full), F.lit(0))))
    swept = (ranked.withColumn("budget", F.sum("source_size").over(every) * F.lit(budget_share))
             .withColumn("all_weight", F.sum("weight").over(every))
             .withColumn("level", level)
             .withColumn("held", F.col("cap") / F.col("weight") <= F.col("level")))
    free = F.min(F.when(~F.col("held"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)
    return swept.withColumn("free_level", free["level"]).select(
        "source", "source_rank", "rows", "source_size", "weight",
        F.when(F.col("held"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("free_level")).alias("target"),
        "budget")


def _queue(docs: DataFrame, carry: Column, carry_as: str, id_col: str, text_col: str, source_col: str, weights,
           budget_share: float, epochs: int) -> DataFrame:
    """Every row with ``cumulative``, the tokens of its source up to and with it in shuffled order."""
    text = F.col(f"`{text_col}`")
    sized = docs.select(
        carry.alias(carry_as), F.col(f"`{source_col}`").alias("source"), F.size(words(text)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")).alias("order_key"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("text_key"))
    if carry_as == "doc_id":
        sized = written(sized, "mix-sizes")  # small rows; where whole rows are carried the texts are read twice instead
    sources = written(targets(sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size")),
                              weights, budget_share, epochs), "mix-targets")
    buckets = F.ceil(F.col("rows") / BUCKET_ROWS)
    spread = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    # the other side has one row per source, not per document
    known = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.*", "s.source_rank", "s.source_size", "s.target", "s.budget", F.floor(spread * buckets).alias("bucket"))
    totals = known.groupBy("source_rank", "bucket").agg(F.sum("size").alias("_sum"))
    before = totals.select(
        F.col("source_rank").alias("_rank"), F.col("bucket").alias("_bucket"),
        F.coalesce(F.sum("_sum").over(W.partitionBy("source_rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"))
    inside = (W.partitionBy("source_rank", "bucket").orderBy("order_key", "size", "text_key")
              .rowsBetween(W.unboundedPreceding, 0))
    run = known.withColumn("_inside", F.sum("size").over(inside))
    placed = run.join(before, (F.col("source_rank") == F.col("_rank")) & (F.col("bucket") == F.col("_bucket")))
    return placed.select(carry_as, "source", "source_rank", "size", "source_size", "target", "budget",
                         (F.col("_before") + F.col("_inside")).alias("cumulative"))


def _finish(copy: int) -> Column:
    return F.when(F.col("size") > 0, (F.col("cumulative") + F.col("source_size") * copy) / F.col("target"))


def _place(copy: int) -> Column:
    """Where a copy stands in the sequence. Within a source no two copies of non-empty rows end at the same count."""
    return F.struct(_finish(copy).alias("finish"), F.col("source_rank").alias("source_rank"))


def _cell(finish: Column) -> Column:
    return F.least(F.floor(finish * (CELLS // 4)), F.lit(CELLS))


def _cut(queue: DataFrame, epochs: int) -> tuple[float, int]:
    """The last place of the sequence that the budget reaches, as (finish, source_rank)."""
    copies = queue.where("size > 0").select(
        "size", "budget", F.explode(F.array(*[_place(k) for k in range(epochs)])).alias("place"))
    copies = copies.withColumn("cell", _cell(F.col("place.finish")))
    cells = copies.groupBy("cell").agg(F.sum("size").alias("tokens"), F.first("budget").alias("budget"))
    # at most CELLS + 1 rows
    upto = F.sum("tokens").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
    over = cells.withColumn("upto", upto).where(F.col("upto") > F.col("budget")).orderBy("cell").limit(1).first()
    if over is None:
        return float("inf"), 0
    inside = F.sum("size").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    edge = copies.where(F.col("cell") == over["cell"]).withColumn("upto", inside + (over["upto"] - over["tokens"]))
    last = edge.where(F.col("upto") <= F.col("budget")).agg(F.max("place").alias("place")).first()["place"]
    return (last["finish"], last["source_rank"]) if last else (over["cell"] / (CELLS // 4), -1)


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken, finish (of its first copy)."""
    prepare(docs.sparkSession)
    queue = written(_queue(docs, F.col(f"`{id_col}`"), "doc_id", id_col, text_col, source_col, weights, budget_share, epochs),
                    "mix-queue")
    return _dealt(queue, _cut(queue, epochs), epochs).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
        _finish(0).alias("finish"))


def _dealt(queue: DataFrame, cut: tuple[float, int], epochs: int) -> DataFrame:
    end = F.struct(F.lit(cut[0]).alias("finish"), F.lit(cut[1]).alias("source_rank"))
    got = sum((F.when((F.col("size") > 0) & (_place(k) <= end), 1).otherwise(0) for k in range(epochs)), F.lit(0))
    return queue.withColumn("copies", got)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: every taken copy as a row of ``docs`` plus ``mix_copy`` and ``mix_finish``, range-sorted by finish time.

    Where ``docs`` has columns of these names the new ones get an underscore in front.
    """
    prepare(docs.sparkSession)
    options = (id_col, text_col, source_col, weights, budget_share, epochs)
    # the cut is found on small rows; the whole rows then pass one shuffle for their place and one for the order
    small = written(_queue(docs, F.col(f"`{id_col}`"), "doc_id", *options), "mix-queue")
    carry = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    dealt = _dealt(_queue(docs, carry, "_row", *options), _cut(small, epochs), epochs)
    lower = {c.lower() for c in docs.columns}
    copy, finish = [n if n not in lower else fresh(docs, n)[0] for n in ("mix_copy", "mix_finish")]
    rows = dealt.where("copies > 0").select("_row", "source_rank", F.explode(F.array(*[
        F.struct(F.lit(k + 1).alias("copy"), _finish(k).alias("finish")) for k in range(epochs)])).alias("_c"), "copies")
    rows = rows.where(F.col("_c.copy") <= F.col("copies"))
    return rows.repartitionByRange(F.col("_c.finish"), "source_rank").sortWithinPartitions("_c.finish", "source_rank").select(
        *[F.col("_row")[c].alias(c) for c in docs.columns], F.col("_c.copy").alias(copy), F.col("_c.finish").alias(finish))
