"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Every document becomes a sparse vector: its distinct words hashed to ``WORD_SLOTS``
slots (equal weights, unit length), one slot for the bucket of each structure
statistic, and one slot for each metadata column's value (numbers by power of
two). The model is ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pair
term is computed in time linear in the vector's entries as
``1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.

Training uses at most ``MAX_TRAIN`` labelled documents of the given table (those
with the smallest id hash), whose vectors alone come to the driver; the model has a fixed size and
is broadcast; scoring runs in Arrow batches over all rows.

Edge cases: null and empty texts are scored from structure alone; without any
label the score is 0.5; documents with several labels count by their mean
(0.5 and more is 1); repeated rows are scored alike; an empty table gives an
empty result; other columns are ignored by ``score`` and kept by ``filter_rows``.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textarrays as ta
from .common import fresh, prepare

WORD_BITS = 14
WORD_SLOTS = 1 << WORD_BITS
META_SLOTS = 1 << 10
RANK = 8
MAX_TRAIN = 6000
EPOCHS = 6
BATCH = 128
#: Texts looked at together: every word of theirs takes some hundred bytes on the way to a score.
RUN_BYTES = 1 << 19

_RATIOS = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9])
_BUCKETS = 16
_STATS = ("words", "bytes", "word_length", "symbols", "capitals", "digits", "marks", "shouts", "lines", "wide", "short",
          "distinct")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_BYTES = {
    "symbols": _class(b"#*$%&|<>@^~_=+{}[]\\"),
    "capitals": _class(bytes(range(65, 91))),
    "digits": _class(bytes(range(48, 58))),
    "marks": _class(b".,;:?\"'()-/"),
    "shouts": _class(b"!"),
    "lines": _class(b"\n"),
    "wide": _class(bytes(range(128, 256))),
}
SLOTS = WORD_SLOTS + _BUCKETS * len(_STATS) + META_SLOTS


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each document's bytes after a table look-up."""
    out = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=np.int64)
    return out


def vectors(texts: pa.Array, metas: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slots, values, entries per document) for consecutive runs of documents of about ``RUN_BYTES``."""
    data, offsets = ta.flat(texts)
    for i, j in ta.batches_of(np.diff(offsets), RUN_BYTES):
        off = offsets[i:j + 1] - offsets[i]
        part = data[offsets[i]:offsets[j]]
        h, start, end, counts = ta.words(part, off)
        n = j - i
        doc = np.repeat(np.arange(n, dtype=np.int64), counts)
        keys = np.unique(doc << WORD_BITS | (h >> np.uint64(64 - WORD_BITS)).astype(np.int64))
        owner, slot = keys >> WORD_BITS, keys & (WORD_SLOTS - 1)
        distinct = np.bincount(owner, minlength=n)
        value = 1 / np.sqrt(np.maximum(distinct, 1))[owner]
        size = np.maximum(np.diff(off), 1)
        word_bytes = np.bincount(doc, weights=end - start, minlength=n)
        some = np.maximum(counts, 1)
        stats = [np.log2(counts + 1), np.log2(np.diff(off) + 1), np.minimum(word_bytes / some, 15)]
        stats += [np.searchsorted(_RATIOS, _sums(_BYTES[c][part], off) / size) for c in _STATS[3:10]]
        stats += [np.searchsorted(_RATIOS, np.bincount(doc, weights=end - start <= 3, minlength=n) / some),
                  np.searchsorted(_RATIOS, distinct / some)]
        slots, owners = [slot], [owner]
        for k, s in enumerate(stats):
            slots.append(WORD_SLOTS + k * _BUCKETS + np.minimum(s, _BUCKETS - 1).astype(np.int64))
            owners.append(np.arange(n))
        for m in metas:
            slots.append(WORD_SLOTS + _BUCKETS * len(_STATS) + np.asarray(m[i:j].to_numpy(zero_copy_only=False), np.int64))
            owners.append(np.arange(n))
        values = np.concatenate([value, np.ones((len(slots) - 1) * n)])
        slots, owners = np.concatenate(slots), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        yield slots[order], values[order], np.bincount(owners, minlength=n)


def _meta(metadata: tuple[str, ...], dtypes: dict[str, str]) -> list[Column]:
    """Each metadata column as a slot number; numbers by power of two, null as a value of its own."""
    out = []
    for c in metadata:
        col = F.col(f"`{c}`")
        if dtypes[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
            col = F.floor(F.log2(F.abs(col.cast("double")) + 1))
        value = F.concat(F.lit(f"{c}="), F.coalesce(col.cast("string"), F.lit("null")))
        out.append(F.pmod(F.xxhash64(value), F.lit(META_SLOTS)).alias(f"_m_{c}"))
    return out


def _forward(model: dict, slots: np.ndarray, values: np.ndarray, entries: np.ndarray):
    """Scores by the sum-of-squares identity; every document has at least its structure entries."""
    first = np.cumsum(entries) - entries
    v = model["v"][slots] * values[:, None]
    total = np.add.reduceat(v, first, axis=0)
    squares = np.add.reduceat((v * v).sum(axis=1), first)
    linear = np.add.reduceat(model["w"][slots] * values, first)
    raw = model["w0"] + linear + 0.5 * ((total * total).sum(axis=1) - squares)
    return raw, total, v


class _Rows(Sequence):
    """(label, slots, values) by id, each made from the Arrow table when it is asked for: only a batch's are there at a time."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").to_pylist()
        self._order = sorted(range(len(ids)), key=ids.__getitem__)
        self._y, self._slots, self._values = table.column("y").to_pylist(), table.column("slots"), table.column("values")

    def __len__(self) -> int:
        return len(self._order)

    def __getitem__(self, at: int) -> tuple[int, np.ndarray, np.ndarray]:
        k = self._order[at]
        return self._y[k], self._slots[k].values.to_numpy(), self._values[k].values.to_numpy().astype(float)


def train(rows: Sequence[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> dict:
    """Adagrad over mini-batches; ``rows`` are (label, slots, values)."""
    rng = np.random.default_rng(seed)
    model = {"w0": 0.0, "w": np.zeros(SLOTS), "v": rng.normal(0, 0.05, (SLOTS, RANK))}
    if not rows:
        model["v"][:] = 0
        return model
    share = min(0.99, max(0.01, float(np.mean([r[0] for r in rows]))))
    model["w0"] = float(np.log(share / (1 - share)))
    g_w, g_v, g0 = np.full(SLOTS, 1e-2), np.full((SLOTS, RANK), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            part = [rows[k] for k in order[at:at + BATCH]]
            y = np.array([r[0] for r in part], float)
            slots, values = np.concatenate([r[1] for r in part]), np.concatenate([r[2] for r in part])
            entries = np.array([len(r[1]) for r in part])
            raw, total, v = _forward(model, slots, values, entries)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / len(part)
            owner = np.repeat(np.arange(len(part)), entries)
            d_w = np.bincount(slots, weights=error[owner] * values, minlength=SLOTS)
            used = np.unique(slots)
            d_w = d_w[used] + 1e-5 * model["w"][used]
            pair = error[owner, None] * values[:, None] * (total[owner] - v)
            d_v = np.zeros((SLOTS, RANK))
            np.add.at(d_v, slots, pair)
            d_v = d_v[used] + 1e-4 * model["v"][used]
            g_w[used] += d_w ** 2
            g_v[used] += d_v ** 2
            g0 += error.sum() ** 2
            model["w"][used] -= 0.1 * d_w / np.sqrt(g_w[used])
            model["v"][used] -= 0.05 * d_v / np.sqrt(g_v[used])
            model["w0"] -= 0.1 * error.sum() / np.sqrt(g0)
    return model


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", metadata: tuple[str, ...] = (), max_train: int = MAX_TRAIN) -> dict:
    """Train on at most ``max_train`` labelled rows of ``docs``; ``use`` (over the labels' id) says which may be learnt from."""
    prepare(docs.sparkSession)
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_y"))
    known = known.where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
    if use is not None:
        known = known.where(use)
    known = known.groupBy("_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
    # labels of ids that docs has no row of must not use up the sample; only ids are shuffled
    known = known.join(docs.select(F.col(f"`{id_col}`").alias("_id")), "_id", "left_semi")
    # at most max_train small rows: safe to broadcast at any size of the input
    known = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(max_train))
    meta = _meta(metadata, dict(docs.dtypes))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"), *meta)
    names = texts.columns[2:]
    texts = texts.join(known, "_id").groupBy("_id", "_y").agg(F.min(F.struct("_t", *names)).alias("_s"))
    texts = texts.select("_id", "_y", "_s.*")

    def vectorised(batches):
        for b in batches:
            metas = [b.column(n) for n in names]
            at = 0
            for slots, values, entries in vectors(b.column("_t"), metas):
                k = len(entries)
                ends = np.concatenate([[0], np.cumsum(entries)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    b.column("_id")[at:at + k], b.column("_y")[at:at + k],
                    pa.ListArray.from_arrays(ends, pa.array(slots, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(values, pa.float32()))], ["id", "y", "slots", "values"])
                at += k

    kind = dict(texts.dtypes)["_id"]
    # as Arrow, which takes 12 bytes an entry; as rows of Python objects an entry took some 70
    rows = texts.mapInArrow(vectorised, f"id {kind}, y int, slots array<int>, values array<float>").toArrow()
    return train(_Rows(rows))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
          metadata: tuple[str, ...] = ()) -> DataFrame:
    """(id, score): probability of label 1 for every row."""
    prepare(docs.sparkSession)
    meta = _meta(metadata, dict(docs.dtypes))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"), *meta)
    names = texts.columns[2:]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        m = shared.value
        for b in batches:
            parts = [_forward(m, *x)[0] for x in vectors(b.column("_t"), [b.column(n) for n in names])]
            raw = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], [id_col, "score"])

    kind = dict(texts.dtypes)["_id"]
    return texts.mapInArrow(scored, f"`{id_col}` {kind}, score double")


def filter_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text",
                metadata: tuple[str, ...] = (), learn: DataFrame | None = None, **options) -> DataFrame:
    """The rows of ``docs`` scored at ``threshold`` or more, all columns as they are; no row of ``docs`` is shuffled.

    The model learns from the labelled rows of ``learn`` (default ``docs``). Where an earlier filter has
    made ``docs``, ``learn`` should be the unfiltered table: the filter may have taken one label's rows.
    """
    model = fit(docs if learn is None else learn, labels, text_col=text_col, metadata=metadata, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = fresh(docs, *[f"m_{k}" for k in range(len(metadata))])
    wide = docs.select("*", *[c.alias(n) for c, n in zip(_meta(metadata, dict(docs.dtypes)), names)])
    width, place = len(docs.columns), docs.columns.index(text_col)

    def kept(batches):
        m = shared.value
        for b in batches:
            metas = [b.column(width + k) for k in range(len(names))]
            rows = pa.RecordBatch.from_arrays(b.columns[:width], b.schema.names[:width])
            at = 0
            for x in vectors(b.column(place), metas):
                raw = _forward(m, *x)[0]
                good = pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))) >= threshold)
                # a run at a time, so that what is kept is not copied as a whole
                yield rows.slice(at, len(raw)).filter(good)
                at += len(raw)

    return wide.mapInArrow(kept, docs.schema)
