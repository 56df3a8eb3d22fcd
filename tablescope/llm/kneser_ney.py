"""An interpolated modified Kneser-Ney n-gram model, counted in Spark.

A text's tokens are its words (hashed, A-Z lower-cased) and one end; where the
context reaches over the text's beginning it is filled with start marks. Counting
is one pass over the training texts: every task counts its n-grams, some millions at a
time, and sends them to shards, as places in a list of words, by byte planes and
compressed; frequent words stand in these lists as their numbers in a dictionary of bounded size. A shard is chosen by an n-gram's middle (all but the first and the last token): there, all
n-grams of a context and all n-grams of a suffix stand together, so contexts and, below trigrams, bigrams
are counted without another shuffle. Middles with more n-grams than fit in part of a shard are
hot: they are split by the first token, and their suffixes are dealt anew. Hot middles number
``1 << HOT_BITS`` at most. Orders above three deal all suffixes anew, order by order.

Each shard writes its counts as sorted hash arrays: an index of the keys' first bits, the 32 bits
behind them, and one byte for a count (or for the row of a table of common context sums) with a list
of those that need more, all in one file. A context that was seen once only is not written, as the
(n-1)-gram of the same tokens is.

The files lie in the shared scratch folder. Scoring tasks map them into memory
and look up the hashes of a batch, shard by shard, so a task
holds a batch, not the model. A map holds a file open; a task keeps as many as half of the files that its process
may open, and opens those of further shards each time it needs them. c is the number of times an n-gram of the highest
order was seen, and for the lower orders the number of different tokens before it
(for n-grams that begin with a start mark, the number of times they were seen).
With discounts D1, D2, D3+ of every order from its counts of counts, h the context
and h' the context without its first token

    p(w | h) = max(c(hw) - D(c(hw)), 0) / c(h) + g(h) * p(w | h')
    g(h)     = (D1 N1(h.) + D2 N2(h.) + D3+ N3+(h.)) / c(h)
    p(w)     = max(c(w) - D'(c(w)), 0) / N1+(..) + g' / (V + 1)

and p(w | h) = p(w | h') after a context that was never seen.

Edge cases: null and empty texts have the end as their only token; very long texts are
one batch each and count whole; without
training text every probability is 1; repeated rows count and are scored each on
its own; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import json
import mmap
import os
import resource
import tempfile
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablescope.session import scratch_path

from . import textarrays as ta
from .common import prepare, written

START = np.uint64(0x243F6A8885A308D3)
END = np.uint64(0x13198A2E03707344)
ORDER = 3
#: At most 2^HOT_BITS strings of a length are hot: none is over 1/2^HOT_BITS of all tokens without being one.
HOT_BITS = 20
SHARD_TOKENS = 2_500_000
#: Tokens that a task counts before it sends n-grams to the shards.
FLUSH_TOKENS = 2_500_000
#: Frequent words that have a number.
DICTIONARY = 1 << 17
#: Words that a task proposes for the dictionary.
TASK_WORDS = 1 << 16
BATCH_BYTES = 4 << 20
#: An index of keys keeps whole numbers for one in 2^BLOCK_BITS of its entries.
BLOCK_BITS = 6
#: Files that a task keeps mapped, where its process may open more than twice as many; Linux allows a process 65530 maps.
MOST_MAPS = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _key(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return ta.fmix(context * _MIX + token)


def _range_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of the upper 32 bits a hash lies in."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray, order: int):
    """(tokens as one column for every place of an n-gram, the last the token itself; tokens per document)."""
    h, _, _, counts = ta.words(data, offsets)
    sizes = counts + 1
    ends = np.cumsum(sizes)
    token = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    token[np.arange(len(h)) + np.repeat(np.arange(len(counts)), counts)] = h
    token[ends - 1] = END
    place = np.arange(len(token)) - np.repeat(ends - sizes, sizes)
    grams = [token]
    for back in range(1, order):
        before = np.full(len(token), START)
        before[back:] = np.where(place[back:] >= back, token[:len(token) - back], START)
        grams.insert(0, before)
    return grams, sizes


def _batches(texts: pa.Array, order: int):
    data, offsets = ta.flat(texts)
    for i, j in ta.batches_of(np.diff(offsets), BATCH_BYTES):
        yield tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], order)


# -- files ---------------------------------------------------------------------------------------

def _local(path: str) -> str | None:
    url = urlparse(path)
    return unquote(url.path) if url.scheme in ("", "file") else None


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Write arrays into one file, behind a head that says where they are; a task that runs twice leaves one whole file."""
    places, size = {}, 0
    for key, array in arrays.items():
        places[key] = array.dtype.str, size, array.size
        size += -(-array.nbytes // 8) * 8
    head = json.dumps(places).encode()
    head += b" " * (-len(head) % 8)
    pieces = [np.array([len(head)], np.int64).tobytes(), head]
    for array in arrays.values():
        pieces += [np.ascontiguousarray(array).reshape(-1).view(np.uint8), bytes(-array.nbytes % 8)]
    local = _local(folder)
    if local is None:
        from pyarrow import fs
        store, at = fs.FileSystem.from_uri(folder)
        with store.open_output_stream(f"{at}/{name}") as out:
            for piece in pieces:
                out.write(piece)
        return
    os.makedirs(local, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=local)
    with os.fdopen(fd, "wb") as out:
        for piece in pieces:
            out.write(piece)
    os.replace(temporary, f"{local}/{name}")


def _arrays(file) -> dict[str, np.ndarray]:
    """The arrays of a file as views of one read-only map."""
    whole = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    end = 8 + int(np.frombuffer(whole, np.int64, 1)[0])
    return {key: np.frombuffer(whole, kind, n, end + start) for key, (kind, start, n) in json.loads(whole[8:end]).items()}


def _mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; a file of a remote store is copied to an unnamed local one first."""
    local = _local(folder)
    if local is not None:
        with open(f"{local}/{name}", "rb") as file:
            return _arrays(file)
    from pyarrow import fs
    store, at = fs.FileSystem.from_uri(folder)
    with tempfile.TemporaryFile() as copy, store.open_input_stream(f"{at}/{name}") as source:
        while part := source.read(1 << 22):
            copy.write(part)
        copy.flush()
        return _arrays(copy)


# -- counting ------------------------------------------------------------------------------------

def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of 64-bit hashes, and the hashes in it.

    A key's upper bits with its place behind them are one number; numbers are sorted several times faster than places by
    their keys. Keys that differ in the lower bits alone are put right afterwards.
    """
    low = np.uint64((1 << max(1, (len(keys) - 1).bit_length())) - 1)
    packed = keys & ~low
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & low).view(np.int64)
    ordered = keys[order]
    wrong = np.flatnonzero(ordered[1:] < ordered[:-1])
    if len(wrong) > 1000:  # no hashes
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    for head in np.unique(ordered[wrong] & ~low):
        at, end = np.searchsorted(packed, head), np.searchsorted(packed, head | low, "right")
        order[at:end] = order[at:end][np.argsort(ordered[at:end], kind="stable")]
        ordered[at:end] = np.sort(ordered[at:end])
    return order, ordered


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted hashes, and every hash's place among them."""
    order, ordered = _sorted(hashes)
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(hashes) else np.zeros(0, bool)
    place = np.empty(len(hashes), np.int64)
    place[order] = np.cumsum(first) - 1
    return ordered[first], place


def _summed(keys: np.ndarray, *columns: np.ndarray):
    """Distinct sorted keys, the sum of every column by key, and where a key first stood."""
    order, ordered = _sorted(keys)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns]
    return ordered[first], sums, order[first]


def _chain(columns: list[np.ndarray]) -> np.ndarray:
    """One hash for a string of tokens; a single token is its own hash."""
    key = columns[0]
    for column in columns[1:]:
        key = _key(key, column)
    return key


def _overview(texts: DataFrame, order: int, most: int) -> tuple[int, dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Number of tokens, by length the strings in an n-gram's middle with over ``most`` occurrences (hashes, parts), and
    the most frequent words, sorted by hash."""
    lengths = range(1, max(1, order - 2) + 1)
    size = texts.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    bound = (size["b"] or 0) // 2 + 2 * size["n"] + 1  # tokens are at least that few
    share = max(most / bound, 2.0 ** -HOT_BITS)

    def counted(batches):
        total, seen = 0, {j: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for j in lengths}
        for b in batches:
            for grams, _ in _batches(b.column("text"), max(lengths) + 1):
                total += len(grams[0])
                for j in lengths:
                    h, n = np.unique(_chain(grams[-1 - j:-1]), return_counts=True)
                    keys, (sums,), _ = _summed(np.concatenate([seen[j][0], h]), np.concatenate([seen[j][1], n]))
                    seen[j] = keys, sums
        # a string with a share of all tokens has that share of the tokens of some task
        often = {j: n > share * total for j, (_, n) in seen.items()}
        # and a task's most frequent words, for the dictionary
        if len(seen[1][1]) > TASK_WORDS:
            often[1] |= seen[1][1] > np.partition(seen[1][1], -TASK_WORDS)[-TASK_WORDS]
        else:
            often[1][:] = True
        rows = [(j, seen[j][0][often[j]], seen[j][1][often[j]]) for j in lengths]
        length = np.concatenate([[0], *[np.full(len(h), j) for j, h, _ in rows]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(length.astype(np.int32)), pa.array(np.concatenate([np.zeros(1, np.uint64), *[h for _, h, _ in rows]]).view(np.int64)),
             pa.array(np.concatenate([[total], *[n for _, _, n in rows]]).astype(np.int64))], ["length", "h", "n"])

    sums = texts.mapInArrow(counted, "length int, h long, n long").groupBy("length", "h").agg(F.sum("n").alias("n"))
    sums = written(sums, "frequent-middles")
    n_tokens = sums.where("length = 0").agg(F.sum("n").alias("n")).first()["n"] or 0
    # counts may lack tasks in which a string was rare; where it is split does not change any result
    most = max(most, n_tokens >> HOT_BITS)
    hot = {j: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for j in lengths}
    found = sums.where((F.col("length") > 0) & (F.col("n") > most)).toPandas()
    for j, own in found.groupby("length"):
        h, n = own["h"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(np.int64)
        by = np.argsort(h)
        hot[int(j)] = h[by], -(-n[by] // most)
    words = sums.where("length = 1").orderBy(F.desc("n"), "h").limit(DICTIONARY).select("h").toPandas()
    return n_tokens, hot, np.sort(words["h"].to_numpy(np.int64).view(np.uint64))


def _deal(level: int, grams: list[np.ndarray], hot: dict, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, whether the middle is hot) of n-grams; a bigram's middle is its first token."""
    middle, side = (grams[0], grams[1]) if level == 2 else (_chain(grams[1:-1]), grams[0])
    known, parts = hot[max(1, level - 2)]
    at, found = _find(known, middle)
    split = np.ones(len(middle), np.int64)
    split[found] = parts[at[found]]
    part = (ta.fmix(side) % split.astype(np.uint64)) if len(known) else np.zeros(len(middle), np.uint64)
    return _range_of(ta.fmix(_key(middle, part)), shards), found


#: Numbers of a word: occurrences, different tokens before it; as a context: sum, and followers with 1, 2, 3+ occurrences.
_WORD_COLUMNS = ("count", "cont", "sum", "n1", "n2", "n3")
#: Rows on their way to a shard: n-grams of ``kind`` tokens, words (1) or counts of counts (0, ``shard`` is the order).
_PARTS = "kind int, shard int, parts array<binary>"
_PARTS_ARROW = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("parts", pa.list_(pa.binary()))])


def _squeeze(array: np.ndarray) -> bytes:
    """An array by byte planes, compressed: sorted or small numbers have planes that nearly vanish."""
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(len(array), array.itemsize).T)
    return np.array([len(array)], np.int64).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _stretch(packed: bytes, kind) -> np.ndarray:
    n, width = int(np.frombuffer(packed, np.int64, 1)[0]), np.dtype(kind).itemsize
    raw = pa.decompress(packed[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(n)


def _split(shard: np.ndarray, shards: int):
    shard = shard.astype(np.uint16 if shards <= 1 << 16 else np.int64)  # sixteen bits are sorted by radix
    order = np.argsort(shard, kind="stable")
    bounds = np.append(np.searchsorted(shard[order], np.arange(shards)), len(shard))
    for s in np.flatnonzero(np.diff(bounds)):
        yield int(s), order[bounds[s]:bounds[s + 1]]


def _list_words(words: np.ndarray, dictionary: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Sorted distinct words as steps between dictionary numbers and between the hashes of the rest, and each word's place in that list."""
    at, found = _find(dictionary, words)
    place = np.where(found, np.cumsum(found) - 1, found.sum() + np.cumsum(~found) - 1)
    return [_squeeze(np.diff(at[found], prepend=0).astype(np.uint32)), _squeeze(np.diff(words[~found], prepend=np.uint64(0)))], place


def _listed(packed: list[bytes], dictionary: np.ndarray) -> np.ndarray:
    numbers = np.cumsum(_stretch(packed[0], np.uint32).astype(np.int64))
    return np.concatenate([dictionary[numbers], np.cumsum(_stretch(packed[1], np.uint64), dtype=np.uint64)])


def _pack_words(words: np.ndarray, columns: list[np.ndarray], shards: int, dictionary: np.ndarray):
    """Rows of ``_PARTS`` with sorted distinct words and their numbers."""
    for s, own in _split(_range_of(words, shards), shards):
        heads, place = _list_words(words[own], dictionary)
        by = own[np.argsort(place)]
        yield 1, s, [*heads, *[_squeeze(c[by].astype(np.int64)) for c in columns]]


def _pack_grams(kind: int, shard: np.ndarray, grams: list[np.ndarray], n: np.ndarray, shards: int, dictionary: np.ndarray):
    """Rows of ``_PARTS`` with n-grams as places in a list of the row's words, sorted by middle so that they compress."""
    for s, own in _split(shard, shards):
        words, places = _distinct(np.concatenate([g[own] for g in grams]))
        heads, place = _list_words(words, dictionary)
        places = place[places].reshape(kind, -1).astype(np.uint16 if len(words) <= 1 << 16 else np.uint32)
        by = np.lexsort([places[-1], places[0], *places[1:-1][::-1]])
        yield kind, s, [*heads, *[_squeeze(p[by]) for p in places], _squeeze(n[own][by].astype(np.uint32))]


def _unpack_grams(kind: int, table: pa.Table, dictionary: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    columns: list[list[np.ndarray]] = [[] for _ in range(kind)]
    counts = []
    for row in table.column("parts"):
        parts = row.as_py()
        words = _listed(parts[:2], dictionary)
        for column, packed in zip(columns, parts[2:-1]):
            column.append(words[_stretch(packed, np.uint16 if len(words) <= 1 << 16 else np.uint32)])
        counts.append(_stretch(parts[-1], np.uint32))
    return [np.concatenate(c) for c in columns], np.concatenate(counts).astype(np.int64)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[], [], []], _PARTS_ARROW)], schema=_PARTS_ARROW)


def _save_keys(folder: str, name: str, keys: np.ndarray, **more: np.ndarray) -> None:
    """Sorted 64-bit keys as an index of their first bits (about four keys each) and the 32 bits behind those, and what belongs to them.

    The index has the start of every block of first bits, and the steps from there."""
    bits = max(BLOCK_BITS, (len(keys) // 4).bit_length())
    index = np.append(0, np.cumsum(np.bincount((keys >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)))
    blocks = index[::1 << BLOCK_BITS]
    steps = index - np.repeat(blocks, 1 << BLOCK_BITS)[:len(index)]
    if steps.max() >= 1 << 16:
        raise OverflowError("keys are not spread like hashes")
    _save(folder, name, blocks=blocks.astype(np.uint32), index=steps.astype(np.uint16),
          keys=((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32), **more)


def _save_grams(folder: str, name: str, keys: np.ndarray, n: np.ndarray) -> None:
    many = np.flatnonzero(n >= 255)
    _save_keys(folder, name, keys, counts=np.minimum(n, 255).astype(np.uint8), large=np.stack([many, n[many]], axis=1).astype(np.int64))


def _save_contexts(folder: str, name: str, keys: np.ndarray, sums: list[np.ndarray]) -> None:
    """Sums of contexts (sum, n1, n2, n3), one byte each: the row of a table of the most common ones, or 255 and a list."""
    small = np.max(sums, axis=0, initial=0) < 1 << 15
    code = np.where(small, sum(c << (15 * k) for k, c in enumerate(sums)), -1)
    common, n = np.unique(code[small], return_counts=True)
    common = np.sort(common[np.argsort(-n, kind="stable")[:255]])
    at, found = _find(common, code)
    rest = np.flatnonzero(~found)
    _save_keys(folder, name, keys, codes=np.where(found, at, 255).astype(np.uint8),
               table=np.stack([(common >> (15 * k)) & 0x7FFF for k in range(4)], axis=1).astype(np.int64),
               large=np.stack([rest, *[c[rest] for c in sums]], axis=1).astype(np.int64))


def _bigrams(folder: str, name: str, grams: list[np.ndarray], n: np.ndarray, hot: np.ndarray) -> list[np.ndarray]:
    """Write whole bigrams with their counts; returns their counts of counts."""
    key = _chain(grams)
    for own, place in ((~hot, "grams2"), (hot, "grams2-hot")):
        at = np.flatnonzero(own)
        if len(at):
            at = at[np.argsort(key[at])]
            _save_grams(f"{folder}/{place}", name, key[at], n[at])
    return [(n == k).sum() for k in (1, 2, 3, 4)]


def _zeros(n: int, **columns) -> list[np.ndarray]:
    return [columns.get(c, np.zeros(n, np.int64)) for c in _WORD_COLUMNS]


def train(docs: DataFrame, use: Column | None = None, text_col: str = "text", shard_tokens: int = SHARD_TOKENS, order: int = 2) -> dict:
    """Count the model of ``order`` (2 or more) and write its arrays; what is returned are the folder, totals and discounts."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs if use is None else docs.where(use)
    texts = rows.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n_tokens, hot, dictionary = _overview(texts, order, max(1, shard_tokens // 8))
    # a shard's n-grams take a column for every place
    shards = max(1, -(-n_tokens * order // (2 * shard_tokens)))
    folder = scratch_path(spark, "kneser-ney")

    def packed(batches):
        held, size = [], 0

        def flush():
            grams = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            _, (n,), first = _summed(_chain(grams), np.ones(len(grams[0]), np.int64))
            grams = [g[first] for g in grams]
            shard, _ = _deal(order, grams, hot, shards)
            for row in _pack_grams(order, shard, grams, n, shards, dictionary):
                yield _table([row]).to_batches()[0]

        for b in batches:
            for grams, _ in _batches(b.column("text"), order):
                held.append(grams)
                size += len(grams[0])
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def as_context(n: np.ndarray) -> dict:
        return {"sum": n, "n1": (n == 1).astype(np.int64), "n2": (n == 2).astype(np.int64), "n3": (n >= 3).astype(np.int64)}

    def numbered(words: np.ndarray, **columns) -> tuple[np.ndarray, list[np.ndarray]]:
        h, sums, _ = _summed(words, *_zeros(len(words), **columns))
        return h, sums

    def word_rows(*parts):
        h, sums, _ = _summed(np.concatenate([h for h, _ in parts]), *[np.concatenate(c) for c in zip(*[c for _, c in parts])])
        return _pack_words(h, sums, shards, dictionary)

    def whole_bigrams(name: str, grams: list[np.ndarray], n: np.ndarray, is_hot: np.ndarray) -> tuple[list[tuple], list]:
        """Rows with their counts of counts, and the numbers of their words."""
        four = _bigrams(folder, name, grams, n, is_hot)
        return [(0, 2, [np.array(four, np.int64).tobytes()])], [numbered(grams[1], cont=np.ones(len(n), np.int64)), numbered(grams[0], **as_context(n))]

    def merged(level: int):
        def one(table: pa.Table) -> pa.Table:
            shard = table.column("shard")[0].as_py()
            grams, n = _unpack_grams(level, table, dictionary)
            key, (n,), first = _summed(_chain(grams), n)
            grams = [g[first] for g in grams]
            words = [numbered(grams[-1], count=n)] if level == order else []
            if level == 2:
                out, more = whole_bigrams(str(shard), grams, n, _deal(2, grams, hot, shards)[1])
                return _table(out + list(word_rows(*words, *more)))
            _save_grams(f"{folder}/grams{level}", str(shard), key, n)
            out = [(0, level, [np.array([(n == k).sum() for k in (1, 2, 3, 4)], np.int64).tobytes()])]
            h, sums, at = _summed(_chain(grams[:-1]), *as_context(n).values())
            # a context seen once is known by the shorter n-gram of its tokens; there is none of start marks alone
            kept = (sums[0] > 1) | (grams[-2][at] == START)
            _save_contexts(f"{folder}/contexts{level}", str(shard), h[kept], [c[kept] for c in sums])
            # a start mark has only start marks before it
            lower = np.where(grams[1] == START, n, 1)
            _, (low,), first = _summed(_chain(grams[1:]), lower)
            short = [g[first] for g in grams[1:]]
            to, is_hot = _deal(level - 1, short, hot, shards)
            if level == 3:
                here = np.flatnonzero(~is_hot)
                rows, more = whole_bigrams(f"{shard}", [g[here] for g in short], low[here], np.zeros(len(here), bool))
                out, words = out + rows, words + more
                away = np.flatnonzero(is_hot)
                short, low, to = [g[away] for g in short], low[away], to[away]
            if len(low):
                out += _pack_grams(level - 1, to, short, low, shards, dictionary)
            return _table(out + (list(word_rows(*words)) if words else []))
        return one

    parts = texts.mapInArrow(packed, _PARTS)
    low = None
    for level in range(order, 1, -1):
        stage = parts.where(F.col("kind") == level).groupBy("shard").applyInArrow(merged(level), _PARTS)
        parts = written(stage, f"level{level}")
        own = parts.where("kind < 2")
        low = own if low is None else low.unionByName(own)

    def words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = table.column("parts").to_pylist()
        keys = np.concatenate([_listed(r[:2], dictionary) for r in rows])
        columns = [np.concatenate([_stretch(r[k], np.int64) for r in rows]) for k in range(2, len(_WORD_COLUMNS) + 2)]
        keys, sums, _ = _summed(keys, *columns)
        _save(f"{folder}/words", str(shard), keys=keys, **{c: values.astype(_WORD_KINDS[c]) for c, values in zip(_WORD_COLUMNS, sums)})
        count, cont = sums[:2]
        return pa.table({"words": [int((count > 0).sum())], "tokens": [int(count.sum())], "types": [int(cont.sum())],
                         "rest": [int((cont >= 3).sum())], **{f"f{k}": [int((cont == k).sum())] for k in (1, 2, 3, 4)}})

    numbers = ("words", "tokens", "types", "rest", "f1", "f2", "f3", "f4")
    totals = low.where("kind = 1").groupBy("shard").applyInArrow(words, ", ".join(f"{c} long" for c in numbers))
    t = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers]).first()

    def fours(batches):
        for b in batches:
            four = [np.frombuffer(r[0], np.int64) for r in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("shard"), *[pa.array([int(f[k]) for f in four], pa.int64()) for k in range(4)]],
                                             ["level", "f1", "f2", "f3", "f4"])

    of_level = low.where("kind = 0").select("shard", "parts").mapInArrow(fours, "level int, f1 long, f2 long, f3 long, f4 long")
    of_level = {r["level"]: [r[f"f{k}"] for k in (1, 2, 3, 4)] for r in of_level.groupBy("level").agg(
        *[F.sum(f"f{k}").alias(f"f{k}") for k in (1, 2, 3, 4)]).collect()}  # one row per order
    return {"folder": folder, "order": order, "shards": shards, "hot": hot, "words": t["words"], "tokens": t["tokens"], "types": t["types"],
            "discounts": {k: _discounts(of_level.get(k, [0] * 4)) for k in range(2, order + 1)},
            "low_discounts": _discounts([t[f"f{k}"] for k in (1, 2, 3, 4)]), "low_four": [t["f1"], t["f2"], t["rest"]]}


_WORD_KINDS = {"count": np.int64, "cont": np.uint32, "sum": np.int64, "n1": np.uint32, "n2": np.uint32, "n3": np.uint32}


def _discounts(four) -> np.ndarray:
    """D1, D2, D3+ from the numbers of n-grams seen one to four times, kept within (0, count)."""
    n1, n2, n3, n4 = (float(x) for x in four)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0] + [min(max(x, 0.1), k * 0.98) for k, x in enumerate(d, 1)])


# -- scoring -------------------------------------------------------------------------------------

class _Reader:
    """The model's arrays, mapped when a shard is first asked for."""

    def __init__(self, model: dict):
        self.model, self.maps, self.held, self.last = model, {}, 0, (None, None)
        allowed = resource.getrlimit(resource.RLIMIT_NOFILE)[0]
        self.most = MOST_MAPS if allowed == resource.RLIM_INFINITY else min(MOST_MAPS, allowed // 2)

    def _map(self, folder: str, s: int) -> dict[str, np.ndarray] | None:
        """The arrays of a shard's file, or None where it has none."""
        key = folder, s
        if key in self.maps:
            return self.maps[key]
        if key != self.last[0]:
            self.last = None, None
            try:
                self.last = key, _mapped(f"{self.model['folder']}/{folder}", str(s))
            except FileNotFoundError:
                self.maps[key] = None
                return None
            # once all that may be held are, the rest are opened anew each time: shards come in the same order again and again
            if self.held < self.most:
                self.maps[key] = self.last[1]
                self.held += 1
        return self.last[1]

    def words(self, hashes: np.ndarray) -> dict[str, np.ndarray]:
        """The numbers of sorted distinct words; 0 where one is unknown."""
        out = {c: np.zeros(len(hashes), np.int64) for c in _WORD_COLUMNS}
        for s, own in _split(_range_of(hashes, self.model["shards"]), self.model["shards"]):
            known = self._map("words", s)
            if known is None:
                continue
            at, found = _find(known["keys"], hashes[own])
            for c in _WORD_COLUMNS:
                out[c][own[found]] = known[c][at[found]]
        return out

    def _places(self, folder: str, s: int, keys: np.ndarray):
        """(which of the keys a shard's file has, where)."""
        file = self._map(folder, s)
        if file is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        index, blocks, known = file["index"], file["blocks"], file["keys"]
        bits = (len(index) - 1).bit_length() - 1
        bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
        at, end = [blocks[b >> BLOCK_BITS].astype(np.int64) + index[b] for b in (bucket, bucket + 1)]
        tail = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        left = np.flatnonzero(at < end)
        which, where = [], []
        while len(left):
            hit = known[at[left]] == tail[left]
            which.append(left[hit])
            where.append(at[left[hit]])
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(which), join(where)

    def _large(self, folder: str, s: int, at: np.ndarray, width: int) -> np.ndarray:
        large = self._map(folder, s)["large"].reshape(-1, width + 1)
        return large[np.searchsorted(large[:, 0], at), 1:]

    def grams(self, level: int, keys: np.ndarray, shard: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Counts of n-grams by their keys."""
        out = np.zeros(len(keys), np.int64)
        parts = (("grams2", ~hot), ("grams2-hot", hot)) if level == 2 else ((f"grams{level}", np.ones(len(keys), bool)),)
        for folder, mine in parts:
            chosen = np.flatnonzero(mine)
            for s, own in _split(shard[chosen], self.model["shards"]):
                own = chosen[own]
                which, at = self._places(folder, s, keys[own])
                if not len(which):
                    continue
                n = self._map(folder, s)["counts"][at].astype(np.int64)
                big = np.flatnonzero(n == 255)
                if len(big):
                    n[big] = self._large(folder, s, at[big], 1)[:, 0]
                out[own[which]] = n
        return out

    def contexts(self, level: int, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """(4, contexts): sum, n1, n2, n3 of contexts; 0 where none is written."""
        out = np.zeros((4, len(keys)), np.int64)
        folder = f"contexts{level}"
        for s, own in _split(shard, self.model["shards"]):
            which, at = self._places(folder, s, keys[own])
            if not len(which):
                continue
            file = self._map(folder, s)
            code = file["codes"][at]
            table = np.concatenate([file["table"].reshape(-1, 4), np.zeros((1, 4), np.int64)])
            sums = table[np.minimum(code, len(table) - 1)]
            big = np.flatnonzero(code == 255)
            if len(big):
                sums[big] = self._large(folder, s, at[big], 4)
            out[:, own[which]] = sums.T
        return out


def _find(known: np.ndarray, wanted: np.ndarray):
    at = np.searchsorted(known, wanted)
    inside = at < len(known)
    found = inside.copy()
    found[inside] = known[at[inside]] == wanted[inside]
    return at, found


def _scored(reader: _Reader, grams: list[np.ndarray], sizes: np.ndarray):
    """(tokens, known tokens, base score, score) of every document."""
    m = reader.model
    v, total, hot, shards = m["words"], m["tokens"], m["hot"], m["shards"]
    words, t = _distinct(np.append(grams[-1], START))
    start, t = t[-1], t[:-1]
    num = reader.words(words)
    low = m["low_discounts"]
    types = max(1, m["types"])
    spare = (low[1] * m["low_four"][0] + low[2] * m["low_four"][1] + low[3] * m["low_four"][2]) / types if m["types"] else 1.0
    cont = num["cont"]
    p = (np.maximum(cont - low[np.minimum(cont, 3)], 0) / types + spare / (v + 1))[t]
    base = np.log10((num["count"] + 0.1) / (total + 0.1 * (v + 1)))
    starts = np.cumsum(sizes) - sizes
    first = np.zeros(len(t), bool)
    first[starts] = True
    n = None
    for level in range(2, m["order"] + 1):
        own = grams[-level:]
        d = m["discounts"][level]
        shard, is_hot = _deal(level, own, hot, shards)
        if level == 2:
            before = np.where(first, start, np.concatenate([[start], t[:-1]]))
            sums = np.stack([num[c][before] for c in _WORD_COLUMNS[2:]])
        else:
            sums = reader.contexts(level, _chain(own[:-1]), shard)
            # a context that is not written was seen once if the n-gram of its tokens, at the place before, is known
            once = (sums[0] == 0) & ~first & (np.concatenate([[0], n[:-1]]) > 0)
            sums[:2, once] = 1
        n = reader.grams(level, _chain(own), shard, is_hot)
        count = np.maximum(sums[0], 1)
        back = (d[1] * sums[1] + d[2] * sums[2] + d[3] * sums[3]) / count
        seen = np.maximum(n - d[np.minimum(n, 3)], 0) / count
        p = np.where(sums[0] > 0, seen + back * p, p)
    known = (num["count"] > 0)[t]
    add = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
    return sizes, add(known.astype(np.int64)), add(base[t]), add(np.log10(p))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity), one row per input row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"))

    def scored(batches):
        reader = _Reader(model)
        for b in batches:
            parts = [_scored(reader, *x) for x in _batches(b.column("_t"), model["order"])]
            n, known, base, own = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0)] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(own, pa.float64()), pa.array(10 ** (-own / np.maximum(n, 1)), pa.float64())],
                [id_col, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(scored, f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")
