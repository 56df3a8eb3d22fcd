"""Factorisation machine: identity, held-out accuracy, edge cases."""
import random

import numpy as np
import pyarrow as pa

from tablescope.llm import quality_fm, textarrays


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    model = {"w0": 0.3, "w": rng.normal(size=quality_fm.SLOTS), "v": rng.normal(size=(quality_fm.SLOTS, 4))}
    slots, values, entries = np.array([3, 9, 200, 4, 9]), np.array([0.5, 1.0, 2.0, 1.0, 0.1]), np.array([3, 2])
    raw = quality_fm._forward(model, slots, values, entries)[0]
    at = 0
    for k, n in enumerate(entries):
        s, x = slots[at:at + n], values[at:at + n]
        want = 0.3 + (model["w"][s] * x).sum() + sum(
            model["v"][s[i]] @ model["v"][s[j]] * x[i] * x[j] for i in range(n) for j in range(i + 1, n))
        assert abs(raw[k] - want) < 1e-9
        at += n


def test_word_hashes_match_words():
    import re
    texts = ["", None, "A b  c\n", "\t", "Éé über", "x" * 3000 + " y", "no\x0bbreak", "a b", "A B"]
    data, offsets = textarrays.flat(pa.array(texts))
    size, textarrays.SLICE = textarrays.SLICE, 64
    try:
        h, s, e, counts = textarrays.words(data, offsets)
    finally:
        textarrays.SLICE = size
    assert [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts] == list(counts)
    whole = textarrays.words(data, offsets)[0]
    assert (h == whole).all() and (h[-4:-2] == h[-2:]).all()


def test_fit_and_score(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, " ".join(word() + ("$$" if bad else "") for _ in range(rng.randint(5, 80))), 1, "z"))
        labels.append((i, 0 if bad else 1))
    rows += [(1000, None, None, "z"), (1001, "", 3, None), (None, "a b", 1, "q"), (3, rows[3][1], 1, "z")]
    labels += [(None, 1), (2000, 0), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, score string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    from pyspark.sql import functions as F
    model = quality_fm.fit(docs, known, use=F.col("_id") % 3 != 0, metadata=("n_chars",))
    got = {r.doc_id: r.score for r in quality_fm.score(docs, model, metadata=("n_chars",)).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    test = [i for i in range(600) if i % 3 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 != 0) for i in test]) > 0.95
    kept = quality_fm.filter_rows(docs, known)
    assert kept.columns == docs.columns and 400 < kept.count() <= 604
    none = docs.limit(0)
    assert quality_fm.score(none, model, metadata=("n_chars",)).count() == 0
    empty_model = quality_fm.fit(docs, known.limit(0))
    assert {r.score for r in quality_fm.score(docs, empty_model).collect()} != set()


def test_sample_is_taken_from_labels_of_given_rows(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "$$ ## %%") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, quality int")
    seen, train = [], quality_fm.train
    quality_fm.train = lambda rows, *a: seen.extend(rows) or train(rows, *a)
    try:
        quality_fm.fit(docs, labels, max_train=40)
    finally:
        quality_fm.train = train
    assert len(seen) == 40 and sum(r[0] for r in seen) == 20


def test_memory_does_not_follow_the_batch():
    import tracemalloc
    rng = random.Random(3)
    some = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(5000)]
    texts = pa.array([" ".join(rng.choices(some, k=400)) for _ in range(4000)] + [None, ""])
    model = {"w0": 0.1, "w": np.ones(quality_fm.SLOTS), "v": np.ones((quality_fm.SLOTS, quality_fm.RANK))}
    textarrays._powers(textarrays._P, 1), textarrays._powers(textarrays._P_INV, 1)
    tracemalloc.start()
    scored = [len(quality_fm._forward(model, *x)[0]) for x in quality_fm.vectors(texts, [])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(scored) == 4002 and peak < 64 << 20  # 166 MB in runs of 4 MB


def test_training_rows_come_as_arrow(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "good words here" if k % 2 else "# $ %") for k in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS quality")
    monkeypatch.setattr(type(docs), "collect", lambda self: 1 / 0)
    seen = []
    monkeypatch.setattr(quality_fm, "train", lambda rows: seen.extend(rows))
    quality_fm.fit(docs, labels)
    assert [y for y, _, _ in seen] == [0, 1] * 20
    assert all(len(s) == len(v) and v.dtype == float and (s < quality_fm.SLOTS).all() for _, s, v in seen)


def test_training_rows_are_made_when_asked_for(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "good words here" if k % 2 else "# $ %") for k in range(40)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality_fm, "train", lambda rows: seen.append(rows))
    quality_fm.fit(docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS quality"))
    rows, = seen
    assert len(rows) == 40 and rows[3][0] == 1 and rows[3][2] is not rows[3][2] and list(rows[3][1]) == list(rows[3][1])
