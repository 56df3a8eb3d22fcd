"""Language identification: held-out accuracy, spans, Viterbi against brute force, edge cases."""
import itertools
import random

import numpy as np

from tablescope.llm import language_id as lid


def test_viterbi_is_best_path():
    rng = np.random.default_rng(4)
    counts = np.array([3, 0, 5, 1, 4])
    scores = rng.normal(size=(counts.sum(), 3)).astype(np.float32)
    path = lid._viterbi(scores, counts, 0.7)
    at = 0
    for n in counts:
        s = scores[at:at + n]
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        if n:
            assert abs(value(path[at:at + n]) - max(map(value, itertools.product(range(3), repeat=int(n))))) < 1e-5
        at += n


def texts(rng, lang, n):
    syllables = {"xx": ["ba", "be", "bo", "ku"], "yy": ["zi", "tra", "plo", "ü"], "ru": ["да", "не", "мо", "ск"]}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_identify(spark):
    rng = random.Random(8)
    rows = [(i, texts(rng, lang, 40), lang, 0.5) for i, lang in enumerate(["xx", "yy", "ru"] * 60)]
    rows += [(900, None, "xx", None), (901, "", "yy", None), (902, "12 34 !", "ru", 1.0), (903, "words", None, 1.0), (None, "ba be", "xx", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = lid.train(docs, use=docs.doc_id % 4 != 2)
    got = {r.doc_id: r for r in lid.identify(docs, model).collect()}
    assert all(got[i].lang_pred == rows[i][2] for i in range(180))
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    a, b, c = texts(rng, "xx", 30), texts(rng, "yy", 50), texts(rng, "ru", 20)
    mixed = spark.createDataFrame([(1, f"{a}. {b}! {c}"), (2, a * 3)], "doc_id long, text string")
    one, two = sorted(lid.identify(mixed, model).collect(), key=lambda r: r.doc_id)
    assert [s.lang for s in one.spans] == ["xx", "yy", "ru"]
    assert (one.spans[0].start, one.spans[0].end) == (0, len(a)) and one.spans[1].start == len(a) + 2
    assert one.lang_pred == "yy" and 0 < one.score < 1 and two.score == 1


def test_slices_do_not_matter(spark):
    rng = random.Random(9)
    docs = [texts(rng, rng.choice(["xx", "yy"]), 50) for _ in range(30)] + ["", "ba"]
    model = {"langs": ["a", "b"], "log": np.random.default_rng(1).normal(size=(lid.SLOTS, 2)).astype(np.float32),
             "barred": np.zeros((32, 2), bool), "known": np.ones(32, bool)}
    whole = lid._labelled(docs, model, 2.0)
    size, lid.CHUNK_CHARS = lid.CHUNK_CHARS, 64
    try:
        sliced = lid._labelled(docs, model, 2.0)
    finally:
        lid.CHUNK_CHARS = size
    assert all((x == y).all() for x, y in zip(whole, sliced))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = lid.train(docs)
    assert [r.lang_pred for r in lid.identify(docs, model).collect()] == ["und"]
    assert lid.identify(docs.limit(0), model).count() == 0
