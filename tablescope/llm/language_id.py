"""Language identification of whole texts, with spans for mixed-language ones.

A word is a run of letters. Its script (by Unicode range) narrows the languages
that may have written it to those whose training letters hold that script; each
of these scores the word by the log probabilities of its letter trigrams. Over a
document's words the Viterbi path with a switching penalty gives every word one
language; runs of a language are the spans, and the language with most letters
is the document's.

The model counts trigrams (hashed to ``SLOTS`` slots) over all training texts in
one distributed aggregation; it has ``SLOTS`` numbers a language and is broadcast.
Scoring runs in Arrow batches with numpy over all documents of a batch at once.

Edge cases: a text that is null or has no letter is ``und`` with score 0; rows
without a language are not learnt from; without any language all are ``und``;
ties go to the language that sorts first; repeated rows are labelled alike; an
empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import prepare

BITS = 15
SLOTS = 1 << BITS
PENALTY = 8.0
SCRIPT_SHARE = 0.02
CHUNK_CHARS = 1 << 20
BATCH_CHARS = 1 << 24

#: The scripts' main Unicode ranges (first, last code point).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
OTHER = len(SCRIPTS)

_TABLES: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower-cased letter (0: not a letter) and its script."""
    if not _TABLES:
        letter = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                letter[c] = ord(low) if len(low) == 1 else c
        script = np.full(0x110000, OTHER, np.uint8)
        for k, ranges in enumerate(SCRIPTS.values()):
            for a, b in ranges:
                script[a:b + 1] = k
        _TABLES["x"] = letter, script
    return _TABLES["x"]


def _parts(text: str):
    """``text`` in parts of at most CHUNK_CHARS characters, cut at blanks where there are any: (start, part)."""
    at = 0
    while len(text) - at > CHUNK_CHARS:
        cut = text.rfind(" ", at, at + CHUNK_CHARS) + 1
        if cut <= at:
            cut = at + CHUNK_CHARS
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


def _packs(texts: list[str]):
    """Groups of (document, start, part) of about CHUNK_CHARS characters."""
    pack, size = [], 0
    for d, text in enumerate(texts):
        for start, part in _parts(text):
            if size + len(part) > CHUNK_CHARS and pack:
                yield pack
                pack, size = [], 0
            pack.append((d, start, part))
            size += len(part) + 1
    if pack:
        yield pack


def _word_grams(pack):
    """Of a pack's words: document, start and length in characters, script, trigram slots and the first slot of each."""
    letter, script = _tables()
    joined = "\n".join(p[2] for p in pack) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = letter[raw]
    inside = low > 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # one trigram around every letter and one that closes the word; what is no letter counts as 0
    x = low.astype(np.uint64)
    before, after = np.concatenate([[0], x[:-1]]).astype(np.uint64), np.concatenate([x[1:], [0]]).astype(np.uint64)
    mixed = (before * np.uint64(0x9E3779B97F4A7C15) + x * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    slots = (mixed >> np.uint64(64 - BITS)).astype(np.int32)[inside]
    first = np.cumsum(end - start) - (end - start)
    lengths = np.array([len(p[2]) + 1 for p in pack])
    begins = np.cumsum(lengths) - lengths
    piece = np.searchsorted(begins, start, "right") - 1
    doc = np.array([p[0] for p in pack], np.int64)[piece]
    offset = start - begins[piece] + np.array([p[1] for p in pack], np.int64)[piece]
    return doc, offset, end - start, script[raw[start]], slots, first


def train(docs: DataFrame, use: Column | None = None, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Trigram log probabilities and script shares of every language; ``use`` says which rows may be learnt from."""
    prepare(docs.sparkSession)
    rows = docs if use is None else docs.where(use)
    rows = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())

    def counted(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for pack in _packs(texts):
                doc, _, length, script, slots, first = _word_grams(pack)
                owner = np.array([p[0] for p in pack])
                names = sorted({langs[d] for d in owner})
                code = np.zeros(len(texts), np.int64)
                for d in owner:
                    code[d] = names.index(langs[d])
                word_lang = code[doc]
                flat = np.bincount(np.repeat(word_lang, length) * SLOTS + slots, minlength=len(names) * SLOTS)
                seen = np.bincount(word_lang * 32 + script, weights=length, minlength=len(names) * 32)
                for k, name in enumerate(names):
                    if name not in total:
                        total[name] = np.zeros(SLOTS + 32, np.int64)
                    total[name][:SLOTS] += flat[k * SLOTS:(k + 1) * SLOTS]
                    total[name][SLOTS:] += seen[k * 32:(k + 1) * 32].astype(np.int64)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(counts[at], pa.int64())], ["lang", "slot", "n"])

    sums = rows.mapInArrow(counted, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = sums.toArrow().to_pandas()  # SLOTS + 32 rows a language at most
    langs = sorted(table["lang"].unique())
    counts = np.zeros((len(langs), SLOTS + 32))
    counts[table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), table["slot"].to_numpy(int)] = table["n"]
    grams, seen = counts[:, :SLOTS], counts[:, SLOTS:]
    log = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * SLOTS))
    allowed = seen / np.maximum(seen.sum(axis=1, keepdims=True), 1) >= SCRIPT_SHARE
    known = allowed.any(axis=0)
    return {"langs": langs, "log": np.ascontiguousarray(log.T, np.float32),
            "barred": np.where(known[:, None], ~allowed.T, False), "known": known}


def _viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word; documents advance together, those with fewer words drop out."""
    n_words, n_langs = scores.shape
    path = np.zeros(n_words, np.int16)
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    live = int((counts > 0).sum())
    if not live:
        return path
    longest = int(counts[0])
    # how many documents have more than t words
    active = live - np.searchsorted(np.sort(counts[:live]), np.arange(longest), "right")
    came = np.zeros((n_words, n_langs), np.int16)
    value = scores[first[:live]].copy()
    own = np.arange(n_langs, dtype=np.int16)
    for t in range(1, longest):
        k = active[t]
        at = first[:k] + t
        v = value[:k]
        top = v.argmax(axis=1)
        switched = v[np.arange(k), top][:, None] - penalty
        came[at] = np.where(v >= switched, own, top[:, None])
        value[:k] = np.maximum(v, switched) + scores[at]
    state = np.zeros(live, np.int16)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        last = counts[:k] == t + 1
        state[:k] = np.where(last, value[:k].argmax(axis=1), state[:k])
        path[at] = state[:k]
        state[:k] = came[at, state[:k]]
    return path


def _labelled(texts: list[str], model: dict, penalty: float):
    """(document, start, length, language) of every word of the texts."""
    columns = []
    log, barred = model["log"], model["barred"]
    for pack in _packs(texts):
        doc, start, length, script, slots, first = _word_grams(pack)
        if not len(doc):
            continue
        score = np.add.reduceat(log[slots], first, axis=0)
        score[~model["known"][script]] = 0
        score[barred[script]] -= 1000
        columns.append((doc, start, length, score))
    if not columns:
        return [np.zeros(0, np.int64)] * 4
    doc, start, length, score = (np.concatenate(c) for c in zip(*columns))
    return doc, start, length, _viterbi(score, np.bincount(doc, minlength=len(texts)), penalty).astype(np.int64)


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY,
             spans: bool = True) -> DataFrame:
    """(id, lang_pred, score[, spans]): the main language, its share of the letters, and runs of one language by characters."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def labelled(batches):
        m = shared.value
        names = np.array([*m["langs"], "und"], object)
        k = len(m["langs"])
        for b in batches:
            texts = ["" if t is None else t for t in b.column("_t").to_pylist()]
            preds, shares, found = [], [], []
            at = 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_CHARS):
                    size += len(texts[to])
                    to += 1
                part = texts[at:to]
                n = len(part)
                if not k:
                    preds.append(np.full(n, 0)), shares.append(np.zeros(n)), found.extend([[]] * n)
                    at = to
                    continue
                doc, start, length, path = _labelled(part, m, penalty)
                votes = np.bincount(doc * k + path, weights=length, minlength=n * k).reshape(n, k)
                total = votes.sum(axis=1)
                preds.append(np.where(total > 0, votes.argmax(axis=1), k))
                shares.append(votes.max(axis=1) / np.maximum(total, 1))
                if spans:
                    new = np.ones(len(doc), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (path[1:] != path[:-1])
                    head = np.flatnonzero(new)
                    tail = np.append(head[1:], len(doc)) - 1
                    here: list[list] = [[] for _ in range(n)]
                    for h, e in zip(head, tail):
                        here[doc[h]].append({"start": int(start[h]), "end": int(start[e] + length[e]), "lang": names[path[h]]})
                    found.extend(here)
                at = to
            pred = np.concatenate(preds) if preds else np.zeros(0, int)
            out = [b.column("_id"), pa.array(names[pred], pa.string()),
                   pa.array(np.concatenate(shares) if shares else np.zeros(0), pa.float64())]
            if spans:
                out.append(pa.array(found, run))
            yield pa.RecordBatch.from_arrays(out, [id_col, "lang_pred", "score", "spans"][:len(out)])

    kind = dict(rows.dtypes)["_id"]
    more = ", spans array<struct<start: long, end: long, lang: string>>" if spans else ""
    return rows.mapInArrow(labelled, f"`{id_col}` {kind}, lang_pred string, score double{more}")
