"""Token counts of whole texts with a public sentencepiece model.

Texts are encoded inside Arrow functions that return lengths only. The encoder
gets lists of about ``BATCH_BYTES``; a longer text is cut into pieces at safe
boundaries first: before a blank that follows another character. No piece of
such a vocabulary holds a blank behind another character (checked when the model
is loaded; otherwise texts are not cut), so no merge reaches over the cut, and
the blank itself is what the encoder puts in front of the next piece.

Edge cases: null counts as the empty text (0 tokens); special strings inside a
text are ordinary text; repeated rows are counted each on its own; an empty
table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textarrays as ta
from .common import prepare

BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 16
LIMIT = 4096

_LOADED: dict = {}
_BLANK = "▁"
_SAFE = re.compile(f"(?<=[^ {_BLANK}]) (?=.)", re.S)


def _model(path: str):
    if path not in _LOADED:
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (m.id_to_piece(i) for i in range(m.get_piece_size()))
        cuttable = not any(_BLANK in p.lstrip(_BLANK) for p in pieces) and (
            m.encode("a b", out_type=str) == m.encode("a", out_type=str) + m.encode("b", out_type=str))
        _LOADED[path] = m, cuttable
    return _LOADED[path]


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """``text`` cut at safe boundaries into parts of about ``size`` characters; the blank at a cut is left out."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        out.append(text[at:cut.start()])
        at = cut.end()
    out.append(text[at:])
    return out


def token_lengths(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES, size: int = PIECE_CHARS) -> np.ndarray:
    """Number of tokens of each text."""
    model, cuttable = _model(path)
    counts = np.zeros(len(texts), np.int64)
    owner: list[int] = []
    parts: list[str] = []
    held = 0

    def flush():
        if parts:
            np.add.at(counts, owner, [len(x) for x in model.encode(parts, num_threads=1)])
            owner.clear(), parts.clear()

    for i, text in enumerate(texts):
        for p in (pieces(text, size) if cuttable and len(text) > size else [text]):
            owner.append(i)
            parts.append(p)
            held += len(p)
            if held >= batch_bytes:
                flush()
                held = 0
    flush()
    return counts


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per input row."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"))

    def counted(batches):
        for b in batches:
            text = b.column("_t")
            sizes = np.diff(ta.flat(text)[1])
            got = [token_lengths(["" if t is None else t for t in text[i:j].to_pylist()], path)
                   for i, j in ta.batches_of(sizes, 4 << 20)]
            n = np.concatenate(got) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(texts.dtypes)["_id"]
    return texts.mapInArrow(counted, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
