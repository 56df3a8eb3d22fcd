"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts and benchmark items become words (runs of letters and digits, lower case).
Each mask of ``MASKS`` names the positions, relative to a word, whose words are
hashed; the positions between are ignored, so a substitution there does not
change the hash. Hashes of all positions of the documents are joined with those
of the items. Around every hit the item is laid along the text on the hit's
diagonal, and a window of ``WINDOW`` words (the whole item if it is shorter) with at
least ``NEED`` equal ones (the same share of a shorter item) is a leak.

With the two masks any window of 13 words with up to two substitutions has a hit
(tests go through all of them), so that the verification sees every such window.

An item of fewer than ``MIN_ITEM`` words is found where all its words stand in a row, by one hash of them all.

A hit leaves its text at once and carries the words beside its item only, so what a text's hits take does not follow its
length; of hits that follow each other on a diagonal, only the first one is made into a row.

Seeds of the benchmark are broadcast up to ``BROADCAST_SEEDS`` rows, with the documents' words beside them;
beyond that bare (document, position, hash) rows are joined by a shuffle, and only hits get their words back.

Edge cases: null and empty texts and items give nothing; very long texts are searched whole; items shorter than
a window have no guarantee for substitutions; windows with equally many equal words: the longest, then the first; repeated rows give one row per id
and item; empty tables give an empty result; other columns are ignored by
``leaks`` and kept by ``clean_rows``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, prepare, written

MASKS = ((0, 1, 2, 3, 4, 6), (0, 2, 3, 7, 8, 9))
WINDOW = 13
NEED = 11
MIN_ITEM = 7
#: Masks of whole short items, by their number of words; their last positions differ from those of MASKS.
SHORT_MASKS = tuple(tuple(range(n)) for n in range(1, MIN_ITEM))
BROADCAST_SEEDS = 200_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seed(words: str, at: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(mask[-1]), *[F.get(F.col(words), at + o) for o in mask])


def seeds(items: DataFrame, masks=MASKS) -> DataFrame:
    """(hash, mask, before, item_id, at): every seed of the items, given (item_id, item_words); one of all words for a short item.

    ``before`` is the hash of the same mask one word earlier, null where there is none."""
    spots = items.select("item_id", "item_words", F.posexplode("item_words").alias("at", "_x"))
    n = F.size("item_words")

    def seed(m, k, fits):
        before = F.when(F.col("at") > 0, _seed("item_words", F.col("at") - 1, m))
        return F.when(fits, F.struct(_seed("item_words", F.col("at"), m).alias("hash"), F.lit(k).alias("mask"), before.alias("before")))

    each = [seed(m, k, (n >= MIN_ITEM) & (F.col("at") + m[-1] < n)) for k, m in enumerate(masks)]
    each += [seed(m, -1, (n == len(m)) & (F.col("at") == 0)) for m in SHORT_MASKS]
    found = spots.select("item_id", "at", F.explode(F.array(*each)).alias("seed"))
    return found.where(F.col("seed").isNotNull()).select("seed.hash", "seed.mask", "seed.before", "item_id", "at").distinct()


def _hits(docs: DataFrame, items: DataFrame, masks, broadcast_seeds: int) -> DataFrame:
    """Of every run of seeds in ``docs`` (key, words): the item, the diagonal and the stretch of the text beside the item."""
    longest = items.groupBy("item_id").agg(F.max(F.size("item_words")).alias("n"))
    known = written(seeds(items, masks).join(longest, "item_id"), "seeds")
    lengths = {r["n"] for r in items.select(F.size("item_words").alias("n")).where(F.col("n") < MIN_ITEM).distinct().collect()}
    each = F.array(*[_seed("words", F.col("pos"), m) for m in (*masks, *[m for m in SHORT_MASKS if len(m) in lengths])])
    # posexplode alone would have Spark split every text once more, to see whether it has a word
    spots = docs.select("key", "words", F.posexplode_outer("words").alias("pos", "_x")).where(F.col("pos").isNotNull())
    small = known.count() <= broadcast_seeds
    if small:
        hits = spots.select("key", "words", "pos", F.explode(each).alias("hash")).join(F.broadcast(known), "hash")
    else:
        bare = spots.select("key", "pos", F.explode(each).alias("hash")).join(known, "hash")
        own = docs.select(F.col("key").alias("_key"), "words")
        # texts that share a key are all laid beside the item; the verification tells them apart
        hits = bare.join(own, F.col("key").eqNullSafe(F.col("_key"))).drop("_key")
    # the seed one word earlier on the same diagonal stands for this one
    earlier = F.coalesce(*[F.when(F.col("mask") == k, _seed("words", F.col("pos") - 1, m)) for k, m in enumerate(masks)])
    again = (F.col("pos") > 0) & F.col("before").isNotNull() & (F.col("before") == earlier)
    hits = hits.where(~F.coalesce(again, F.lit(False)))
    shift = F.col("pos") - F.col("at")
    # the stretch of the text beside the item; -1 words before its start are left out by the offset
    begin = F.greatest(shift, F.lit(0))
    stretch = F.slice("words", begin + 1, F.greatest(F.lit(0), F.col("n") - (begin - shift)))
    hits = hits.select("key", "item_id", shift.alias("shift"), (begin - shift).alias("skip"), stretch.alias("stretch"))
    return hits.join(F.broadcast(items) if small else items, "item_id")


def _verified(hits: DataFrame, window: int, need: int) -> DataFrame:
    """Best window of every hit: (key, item_id, start, matched, length, enough), with whether it has enough equal words."""
    n = F.size("item_words")
    equal = F.transform("item_words", lambda x, j: F.when(
        (j >= F.col("skip")) & F.coalesce(F.get("stretch", j - F.col("skip")) == x, F.lit(False)), 1).otherwise(0))
    step = hits.select("key", "item_id", "shift", n.alias("n"), F.least(n, F.lit(window)).alias("length"), equal.alias("equal"))
    ends = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("length")), lambda o: F.struct(
        F.aggregate(F.slice("equal", o + 1, F.col("length")), F.lit(0), lambda a, x: a + x).alias("matched"), (-o).alias("minus")))
    best = step.select("key", "item_id", "shift", "length", F.array_max(ends).alias("best"))
    return best.select(
        "key", "item_id", (F.col("shift") - F.col("best.minus")).cast("long").alias("start"),
        F.col("best.matched").cast("long").alias("matched"), F.col("length").cast("long").alias("length"),
        (F.col("best.matched") >= F.ceil(F.col("length") * need / window)).alias("enough"))


def _leaks(docs: DataFrame, benchmark: DataFrame, item_id_col: str, item_col: str, masks, window: int, need: int,
           broadcast_seeds: int) -> DataFrame:
    items = benchmark.select(F.col(f"`{item_id_col}`").alias("item_id"), tokens(F.col(f"`{item_col}`")).alias("item_words"))
    items = items.where(F.size("item_words") > 0).distinct()
    found = _verified(_hits(docs, items, masks, broadcast_seeds), window, need)
    # not a filter before: Spark would push it down to the join, and work out the windows there for every word of an item
    best = F.max(F.when(F.col("enough"), F.struct("matched", "length", (-F.col("start")).alias("minus"))))
    return found.groupBy("key", "item_id").agg(best.alias("best")).where(F.col("best").isNotNull()).select(
        "key", "item_id", (-F.col("best.minus")).alias("start"), "best.matched", "best.length")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
          item_col: str = "text", masks=MASKS, window: int = WINDOW, need: int = NEED, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """One row per document id and benchmark item found in it: id, item_id, start (word), matched, length of the best window."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("key"), tokens(F.col(f"`{text_col}`")).alias("words"))
    return _leaks(texts, benchmark, item_id_col, item_col, masks, window, need, broadcast_seeds).withColumnRenamed("key", id_col)


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns as they are."""
    prepare(docs.sparkSession)
    key, = fresh(docs, "text_key")
    digest = F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    texts = docs.select(digest.alias("key"), tokens(F.col(f"`{text_col}`")).alias("words"))
    settings = {"item_id_col": "item_id", "item_col": "text", "masks": MASKS, "window": WINDOW, "need": NEED, "broadcast_seeds": BROADCAST_SEEDS} | options
    bad = written(_leaks(texts, benchmark, **settings).select(F.col("key").alias(key)).distinct(), "leaks")
    return docs.withColumn(key, digest).join(bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
