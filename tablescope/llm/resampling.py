"""Importance resampling towards a target distribution of hashed n-grams.

The words of a text are the runs of letters and digits (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
after A-Z became a-z); its features are all runs of one to three consecutive words,
joined by one space, each in the bucket given by the CRC-32 of its bytes. Two
passes read the texts. The first counts the buckets of all documents and of the
target; a task sends one row per bucket. The gains of the buckets, floors of
scaled log ratios, are one array of ``BUCKETS`` numbers that every task of the
second pass holds; a document's weight is the sum of its features' gains. Gumbel
noise from a digest of the id is added, so the greatest scores are a draw without
replacement in proportion to the weights.

The draw is a distributed quickselect over the scores, written once as a small
table. The composite key (score downwards, id upwards, place of the row in the
table) is unique. Every round takes a few random keys between the bounds as pivots,
counts the rows below and at each of them in one aggregate, and keeps the interval
with the k-th key, until that key is a pivot. Only the winners are sorted: by
ranges, numbered within their range, with the ranges' sums before them. No other
row moves.

Edge cases: null and empty texts have no feature, weight 0 and are not drawn as
they are shorter than ``MIN_WORDS``; a null id is digested as the empty text and
comes last among equal scores; repeated rows count, are scored and drawn each on its
own, and it does not matter which of them is drawn; very long texts are worked off
in slices and count whole; an empty table gives an empty result, an empty target
gives gains that only punish frequent buckets; other columns are ignored.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textarrays as ta
from .common import fresh, prepare, written

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
PIVOTS = 15
BATCH_BYTES = 4 << 20
#: Bytes of a word that are hashed column by column; the rest of longer words goes through zlib.
COLUMNS = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()


def _step(state: np.ndarray, byte) -> np.ndarray:
    return _TABLE[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


class _Words:
    """Words of one slice of bytes, longest first, so that a column of bytes is a prefix of the arrays."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray):
        self.data, self.begin, self.length = data, begin, length
        self.order = np.argsort(-length, kind="stable")
        self.first = begin[self.order]
        most = min(int(length.max(initial=0)), COLUMNS)
        longest = -length[self.order]
        self.active = [int(np.searchsorted(longest, -k)) for k in range(most)]
        self.long = np.flatnonzero(length > COLUMNS)

    def extend(self, state: np.ndarray) -> np.ndarray:
        """CRC registers after the bytes of every word, from the registers before them."""
        x = state[self.order]
        for k, m in enumerate(self.active):
            x[:m] = _step(x[:m], self.data[self.first[:m] + k])
        out = np.empty_like(x)
        out[self.order] = x
        for i in self.long:
            rest = self.data[self.begin[i] + COLUMNS:self.begin[i] + self.length[i]].tobytes()
            out[i] = zlib.crc32(rest, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        return out


def _slices(data: np.ndarray, offsets: np.ndarray):
    """(begin, end) of the words of consecutive slices of bytes; no word is split or reaches over a document's end."""
    inside = _WORD[data]
    starts = np.unique(offsets[:-1])
    starts = starts[starts < len(data)]
    for a, b in ta._cuts(~inside, starts, len(data)):
        part = inside[a:b]
        first, last = part.copy(), part.copy()
        first[1:] &= ~part[:-1]
        last[:-1] &= ~part[1:]
        here = starts[np.searchsorted(starts, a):np.searchsorted(starts, b)] - a
        first[here] = part[here]
        before = here[here > 0] - 1
        last[before] = part[before]
        yield np.flatnonzero(first) + a, np.flatnonzero(last) + a + 1


def features(texts: pa.Array, buckets: int = BUCKETS):
    """(first document, documents, word counts, [(document, bucket), ...]) of runs of documents, every feature once."""
    all_data, all_offsets = ta.flat(texts)
    for i, j in ta.batches_of(np.diff(all_offsets) + 64, BATCH_BYTES):
        offsets = all_offsets[i:j + 1] - all_offsets[i]
        data = _LOWER[all_data[all_offsets[i]:all_offsets[j]]]
        counts = np.zeros(j - i, np.int64)

        def parts():
            # the last word of the slice before: its document and the registers after it and the word before it
            tail_doc, tail_one, tail_two, tail_has_two = -1, np.uint32(0), np.uint32(0), False
            for begin, end in _slices(data, offsets):
                if not len(begin):
                    continue
                doc = np.searchsorted(offsets, begin, "right") - 1
                np.add.at(counts, doc, 1)
                w = _Words(data, begin, end - begin)
                one = w.extend(np.full(len(begin), 0xFFFFFFFF, np.uint32))
                previous = np.concatenate(([tail_doc], doc[:-1])) == doc
                two = w.extend(_step(np.concatenate(([tail_one], one[:-1])).astype(np.uint32), np.uint32(32)))
                three = w.extend(_step(np.concatenate(([tail_two], two[:-1])).astype(np.uint32), np.uint32(32)))
                third = previous & np.concatenate(([tail_has_two], previous[:-1]))
                for keep, state in ((slice(None), one), (previous, two), (third, three)):
                    yield doc[keep], (state[keep] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)
                tail_doc, tail_one, tail_two, tail_has_two = doc[-1], one[-1], two[-1], bool(previous[-1])

        yield i, j, counts, parts()


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of all texts."""
    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, _, parts in features(b.column(0), buckets):
                for _, bucket in parts:
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select(F.col(f"`{text_col}`").alias("_t")).mapInArrow(counted, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for into, table in ((s, docs), (t, target)):
        for row in bucket_counts(table, text_col, buckets).collect():  # one row per bucket at most
            into[row["bucket"]] = row["n"]
    total_s, total_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(t[i]) + 1) * total_s / ((float(s[i]) + 1) * total_t)))
                     for i in range(buckets)], np.int64)


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row."""
    def weighed(batches):
        for b in batches:
            words, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, j, counts, parts in features(b.column("_t"), len(gain)):
                for doc, bucket in parts:
                    weight[i:j] += np.bincount(doc, weights=gain[bucket], minlength=j - i).astype(np.int64)
                words[i:j] = counts
            n = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(words), pa.array(n), pa.array(weight)],
                                             [id_col, "n_words", "n_features", "weight"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_t"))
    rows = rows.mapInArrow(weighed, f"`{id_col}` long, n_words long, n_features long, weight long")
    text_id = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), text_id).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


def _key(rows: DataFrame, id_col: str) -> list[Column]:
    """The composite key, upwards."""
    return [-rows["score"], F.coalesce(rows[id_col], F.lit((1 << 63) - 1)), rows["_place"]]


def _below(key: list[Column], bound: tuple) -> Column:
    a, b, c = key
    x, y, z = (F.lit(v) for v in bound)
    return (a < x) | ((a == x) & ((b < y) | ((b == y) & (c < z))))


def _at(key: list[Column], bound: tuple) -> Column:
    return (key[0] == F.lit(bound[0])) & (key[1] == F.lit(bound[1])) & (key[2] == F.lit(bound[2]))


def kth_key(rows: DataFrame, k: int, id_col: str = "doc_id", pivots: int = PIVOTS) -> tuple:
    """The k-th smallest composite key (k from 1) of a written table with score, id and ``_place``."""
    key = _key(rows, id_col)
    low = high = None
    turn = 0
    while True:
        turn += 1
        between = rows
        if low is not None:
            between = between.where((key[0] >= F.lit(low[0])) & ~_below(key, low) & ~_at(key, low))
        if high is not None:
            between = between.where((key[0] <= F.lit(high[0])) & _below(key, high))
        drawn = between.select(*(c.alias(n) for c, n in zip(key, "abc")))
        drawn = drawn.orderBy(F.xxhash64("a", "b", "c", F.lit(turn))).limit(pivots).collect()
        bounds = sorted((r["a"], r["b"], r["c"]) for r in drawn)
        if not bounds:
            raise ValueError("fewer rows than k")
        found = rows.agg(*(F.count_if(_below(key, p)).alias(f"l{i}") for i, p in enumerate(bounds)),
                         *(F.count_if(_at(key, p)).alias(f"e{i}") for i, p in enumerate(bounds))).first()
        for i, p in enumerate(bounds):
            if found[f"l{i}"] < k <= found[f"l{i}"] + found[f"e{i}"]:
                return p
            if k <= found[f"l{i}"]:
                high = p
                break
            low = p


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank), one row per input row; rank is null where the row is not drawn."""
    prepare(docs.sparkSession)
    scored = scores(docs, gains(docs, target, text_col, buckets), seed, id_col, text_col)
    scored = written(scored.withColumn("_place", F.monotonically_increasing_id()), "scores")
    long_enough = scored.where(F.col("n_words") >= min_words)
    k = long_enough.count() * percent // 100
    out = [id_col, "n_words", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if k == 0:
        return scored.select(*out, unranked)
    key = _key(scored, id_col)
    last = kth_key(long_enough, k, id_col)
    wins = (F.col("n_words") >= min_words) & (_below(key, last) | _at(key, last))
    return ranked(scored.where(wins), id_col).select(*out, "rank").unionByName(
        scored.where(~wins).select(*out, unranked))


def ranked(winners: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The winners with their rank in the order of the composite key."""
    names = ["_a", "_b", "_c"]
    winners = winners.select("*", *(c.alias(n) for c, n in zip(_key(winners, id_col), names)))
    ranges = written(winners.repartitionByRange(*names).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row per range, that is per shuffle partition
    before = sums.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*names))
    return ranges.withColumn("_nr", place).join(F.broadcast(before), "_range").withColumn(
        "rank", (F.col("_before") + F.col("_nr")).cast("long"))


def drawn_rows(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, with all their columns (of rows that share an id, all)."""
    ids = resample(docs, target, id_col=id_col, text_col=text_col, **options).where("rank IS NOT NULL")
    (mine,) = fresh(docs, "drawn")
    ids = ids.select(F.col(id_col).alias(mine)).distinct()
    return docs.join(ids, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(mine)), "left_semi")
