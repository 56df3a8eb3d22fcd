"""Spelling variants: words at one edit, found by dynamic programming along the sorted vocabulary.

Words are the runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts with A-Z in lower case, of
``MIN_LENGTH`` letters and ``MIN_COUNT`` occurrences at least. Two words are near if one
inserted, deleted or replaced letter turns one into the other. A word's form is its
near word with the most occurrences, if these are ``RATIO`` times its own at least;
its root is the end of the chain of forms.

The vocabulary is sorted twice, by the words and by the words read backwards, and cut
into blocks of neighbours. Of two near words of which the longer has L letters, at
least the first or the last (L - 1) / 2 letters agree, rounded up. So a word visits, in
both orders, the blocks that may hold words with the same first half (k letters);
where these are many, only those whose common prefix is within one edit of the
word. In a block all visitors go down the sorted list together. Each list word shares
the rows of the edit matrix, three cells wide, with its predecessor as far as their
common prefix (LCP) reaches, and only the rows beyond it are computed, for the
visitors that are still within one edit. Where none is left, all following words
with at least that prefix are skipped. A pair found in both orders counts in the
first one. Tasks return numbers and the best near word, never pairs.

A block's words and visitors have a bounded size: blocks hold about ``BLOCK_WORDS`` words
(more only where there would be over ``MAX_BLOCKS``), and where many words visit one
block, they come in parts of about ``VISITORS``, each with a copy of the block. The driver
knows the first and last word of each block, nothing else of the vocabulary.

Edge cases: null and empty texts have no words; a null id counts as the empty text;
very long texts are worked off in slices and count whole, very long words are words;
repeated rows count; of near words with equal counts the first in code-point order is
the form; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare, written

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
SLICE = 1 << 22
TASK_WORDS = 300_000
BLOCK_WORDS = 20_000
MAX_BLOCKS = 1 << 16
VISITORS = 40_000
MATRIX_BYTES = 16 << 20
_RUN = re.compile(rb"[a-z\xc0-\xff]+")


def runs(text: str):
    """Counts of the lower-cased runs of a text, as latin-1 bytes, slice by slice; other letters end a run."""
    data = text.encode("latin-1", "replace").lower()
    start = 0
    while start < len(data):
        end = min(start + SLICE, len(data))
        over = _RUN.match(data, end - 1) if end < len(data) else None
        end = over.end() if over else end
        yield Counter(_RUN.findall(data, start, end))
        start = end


def damaged(run: bytes, before: int, every: int) -> bytes:
    """The run without one letter if ``every`` divides its checksum, which goes on from the checksum ``before``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, drop_every: int | None = None) -> DataFrame:
    """(word, n) of the words that are long and frequent enough.

    With ``drop_every`` a letter is left out of every run for which that number divides the
    checksum of ``<id>:<run>``, which plants misspellings.
    """
    def counted(batches):
        total: Counter = Counter()

        def flush():
            out = [(w.decode("latin-1"), n) for w, n in total.items() if len(w) >= min_length]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())],
                                              ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("_id"), b.column("_t")):
                before = zlib.crc32(f"{doc_id.as_py() or ''}:".encode())
                for found in runs(text.as_py() or ""):
                    if drop_every is None:
                        total.update(found)
                    else:
                        for run, n in found.items():
                            total[damaged(run, before, drop_every)] += n
                if len(total) > TASK_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("_id"), F.col(f"`{text_col}`").alias("_t"))
    rows = rows.mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def half(key: bytes) -> int:
    """Letters of a key, its mark included, that a near word in the same order has too (or else the other order has them)."""
    return 1 + (len(key) - 1) // 2


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def reaches(key: bytes, prefix: bytes) -> bool:
    """Whether some word that begins with ``prefix`` may be within one edit of ``key``."""
    i = common(key, prefix)
    if i == len(prefix):
        return True
    after = prefix[i + 1:]
    return key.startswith(after, i + 1) or key.startswith(after, i) or key.startswith(prefix[i:], i + 1)


def scan(words: list[bytes], keys: list[bytes]):
    """(index of a key, index of a word) of all pairs at one edit whose first ``half(key)`` letters agree; words are sorted."""
    lcp = [0, *(common(a, b) for a, b in zip(words, words[1:]))]
    by_length = sorted(range(len(keys)), key=lambda i: len(keys[i]))
    start = 0
    while start < len(by_length):
        stop = start + 1
        while stop < len(by_length) and (stop + 1 - start) * (len(keys[by_length[stop]]) + 3) <= MATRIX_BYTES:
            stop += 1
        part = by_length[start:stop]
        yield from _scan_part(words, lcp, [keys[i] for i in part], np.array(part))
        start = stop


def _scan_part(words: list[bytes], lcp: list[int], keys: list[bytes], number: np.ndarray):
    width = max(map(len, keys)) + 3
    letters = np.frombuffer(b"".join(b"\0" + k.ljust(width - 1, b"\0") for k in keys), np.uint8).reshape(len(keys), width)
    length = np.array([len(k) for k in keys])
    need = np.array([half(k) for k in keys])
    # rows[d]: the keys still within one edit of the first d letters, and their cells d-1, d, d+1 (2: more than one edit)
    everyone = np.arange(len(keys))
    rows = [(everyone, np.full(len(keys), 2, np.int8), np.zeros(len(keys), np.int8), np.full(len(keys), 2, np.int8))]
    p = 0
    while p < len(words):
        word = words[p]
        del rows[lcp[p] + 1:]
        for d in range(len(rows), len(word) + 1):
            who, below, level, above = rows[-1]
            c = word[d - 1]
            if d - 1 > width - 3:
                rows.append((who[:0], below[:0], level[:0], above[:0]))
                break
            same = letters[who, d] == c
            strict = need[who] >= d  # the first half has to agree letter by letter
            if strict.all():
                keep = same & (level == 0)
                who = who[keep]
                ones = np.full(len(who), 2, np.int8)
                # past the half, a letter of the key may have been left out
                free = (need[who] == d) & (length[who] > d)
                rows.append((who, ones, np.zeros(len(who), np.int8), np.where(free, 1, 2).astype(np.int8)))
            else:
                new0 = np.minimum(below + (letters[who, d - 1] != c), level + 1)
                new1 = np.minimum(np.minimum(level + ~same, above + 1), new0 + 1)
                new2 = np.minimum(above + (letters[who, d + 1] != c), new1 + 1)
                exact = same & (level == 0)
                new0 = np.where(strict, 2, new0)
                new1 = np.where(strict, np.where(exact, 0, 2), new1)
                new2 = np.where(strict, np.where(exact & (need[who] == d), 1, 2), new2)
                n = length[who]
                new1 = np.where(n < d, 2, new1)
                new2 = np.where(n < d + 1, 2, new2)
                new0 = np.where(n < d - 1, 2, new0)
                keep = np.flatnonzero(np.minimum(np.minimum(new0, new1), new2) <= 1)
                rows.append((who[keep], *(np.minimum(x[keep], 2).astype(np.int8) for x in (new0, new1, new2))))
            if not len(rows[-1][0]):
                break
        depth = len(rows) - 1
        if not len(rows[-1][0]):
            # no key is within one edit of this prefix: skip all words that begin with it
            p += 1
            while p < len(words) and lcp[p] >= depth:
                p += 1
            continue
        who, below, level, above = rows[-1]
        n = length[who] - len(word)
        found = who[((n == -1) & (below == 1)) | ((n == 0) & (level == 1)) | ((n == 1) & (above == 1))]
        for i in found:
            yield int(number[i]), p
        p += 1


def _visits(fences: list[tuple[bytes, bytes]]):
    """A function that lists the blocks that a key visits."""
    firsts, lasts = [f for f, _ in fences], [e for _, e in fences]
    shared = [f[:common(f, e)] for f, e in fences]

    def blocks(key: bytes) -> list[int]:
        start = key[:half(key)]
        i, found = bisect_left(lasts, start), []
        while i < len(fences) and (firsts[i] <= start or firsts[i].startswith(start)):
            if reaches(key, shared[i]):
                found.append(i)
            i += 1
        return found

    return blocks


def _near_in_block(block: tuple, words: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    """Per visiting word the number of near words here, and the best (most occurrences, then first) of them."""
    words = words.assign(k=[k.encode("latin-1") for k in words["key"]]).sort_values("k")
    listed, counts = words["k"].tolist(), words["n"].tolist()
    visitors = [k.encode("latin-1") for k in keys["key"]]
    n_near: Counter = Counter()
    best: dict[int, tuple[int, str]] = {}
    for i, p in scan(listed, visitors):
        key, other = visitors[i], listed[p]
        if key[:1] == b"r":
            a, b = key[:0:-1], other[:0:-1]
            if common(a, b) >= half(key) - 1:
                continue  # found in the other order
        else:
            b = other[1:]
        n_near[i] += 1
        new = (-counts[p], b.decode("latin-1"))
        best[i] = min(best.get(i, new), new)
    rows = []
    for i, n in n_near.items():
        key = visitors[i]
        word = key[1:] if key[:1] == b"f" else key[:0:-1]
        rows.append((word.decode("latin-1"), n, *best[i]))
    return pd.DataFrame(rows, columns=["word", "n_near", "minus_n", "near"])


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS, visitors: int = VISITORS) -> DataFrame:
    """(word, n_near, form_n, form) of every word that has near words; ``words`` is a written table (word, n)."""
    spark = words.sparkSession
    keys = words.select(F.concat(F.lit("f"), "word").alias("key"), "n").unionByName(
        words.select(F.concat(F.lit("r"), F.reverse("word")).alias("key"), "n"))
    blocks = min(max(1, -(-2 * words.count() // block_words)), MAX_BLOCKS)
    listed = written(keys.repartitionByRange(blocks, "key").withColumn("block", F.spark_partition_id()), "sorted-words")
    fences = listed.groupBy("block").agg(F.min("key").alias("a"), F.max("key").alias("z")).orderBy("a").collect()  # one row per block
    ids = [r["block"] for r in fences]
    bounds = [(r["a"].encode("latin-1"), r["z"].encode("latin-1")) for r in fences]

    def routed(batches):
        visits = _visits(bounds)
        for b in batches:
            at, who = [], []
            for key in b.column(0).to_pylist():
                for i in visits(key.encode("latin-1")):
                    at.append(ids[i])
                    who.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(who, pa.string())], ["block", "key"])

    visiting = written(listed.select("key").mapInArrow(routed, "block int, key string"), "visits")
    parts = visiting.groupBy("block").agg(F.ceil(F.count("*") / visitors).cast("int").alias("parts"))
    parts = F.broadcast(written(parts, "parts"))  # one row per block
    copies = listed.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = visiting.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    near = copies.select("block", "part", "key", "n").groupBy("block", "part").cogroup(
        dealt.select("block", "part", "key").groupBy("block", "part")).applyInPandas(
        _near_in_block, "word string, n_near long, minus_n long, near string")
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "near")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.minus_n")).alias("form_n"), F.col("b.near").alias("form"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of every word of the links (word, form), which have no cycle: the links are doubled until they end."""
    at = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if not at.join(onward, "root", "left_semi").take(1):
            return at
        at = written(at.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                   min_count: int = MIN_COUNT, ratio: int = RATIO, drop_every: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    prepare(docs.sparkSession)
    words = written(vocabulary(docs, id_col, text_col, min_length, min_count, drop_every), "vocabulary")
    near = near_words(words)
    is_form = F.col("form_n") >= ratio * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"),
        F.when(is_form, F.col("form_n")).alias("form_n"))
    forms = written(forms, "forms")
    ends = roots(forms.where("form IS NOT NULL"))
    return forms.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
