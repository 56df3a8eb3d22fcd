"""Weighted fair mixing: targets by iteration, closeness, edge cases."""
import random
from collections import defaultdict

from tablescope.llm import mixing


def iterated(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * level > epochs * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = epochs * sizes[s]
            left -= out[s]
            free.discard(s)


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None, "é"]), 1.0) for i in range(900)]
    rows += [(5, None, "a", None), (None, "x y", "b", 2.0), (7, "same row", "c", 0.0), (7, "same row", "c", 0.0), (8, "", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = mixing.taken(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    want = iterated(dict(sizes))
    for s in sizes:
        assert abs(want[s] - target[s]) < 1e-6 and abs(taken[s] - want[s]) <= 61
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(docs).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_copy", "mix_finish"]
    assert mixed.count() == sum(r.copies for r in got)
    finish = [r.mix_finish for r in mixed.collect()]
    assert finish == sorted(finish)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(docs).count() == 0 and mixing.mix(docs).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.taken(nothing).collect()] == [0, 0]
