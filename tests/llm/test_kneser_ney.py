"""Kneser-Ney model against a dictionary version, edge cases."""
import math
import random
import re
from collections import Counter, defaultdict

from tablescope.llm import kneser_ney as kn


def toks(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


def brute(train):
    big = Counter(p for t in train for p in zip(["<s>", *toks(t)], toks(t)))
    uni = Counter(w for t in train for w in toks(t))
    ctx, cont, follow = Counter(), Counter(), defaultdict(Counter)
    for (u, w), n in big.items():
        ctx[u] += n
        cont[w] += 1
        follow[u][min(n, 3)] += 1
    d, low = kn._discounts([sum(n == k for n in big.values()) for k in (1, 2, 3, 4)]), kn._discounts(
        [sum(n == k for n in cont.values()) for k in (1, 2, 3, 4)])
    v, total, types = len(uni), sum(uni.values()), len(big)
    spare = sum(low[min(n, 3)] for n in cont.values()) / types if types else 1.0

    def p_low(w):
        return max(cont[w] - low[min(cont[w], 3)], 0) / max(1, types) + spare / (v + 1)

    def p(u, w):
        if not ctx[u]:
            return p_low(w)
        g = sum(d[k] * n for k, n in follow[u].items()) / ctx[u]
        return max(big[u, w] - d[min(big[u, w], 3)], 0) / ctx[u] + g * p_low(w)

    def row(t):
        w = toks(t)
        return (len(w), sum(uni[x] > 0 for x in w), sum(math.log10((uni[x] + 0.1) / (total + 0.1 * (v + 1))) for x in w),
                sum(math.log10(p(u, x)) for u, x in zip(["<s>", *w], w)))
    return row, total, p, uni


def test_against_dictionaries(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["the", "The", "of", "a", "b", "c", "dé", "zz"], [9, 3, 5, 1, 1, 1, 1, 1], k=rng.randint(0, 300))) for _ in range(90)]
    texts += [None, "", " \n", "the of", "the of", "unknown words the", "x" * 5000]
    rows = [(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "the a", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(5)
    use = docs.doc_id % 10 != 0
    train = [t for i, t, _ in rows if i is not None and i % 10]
    row, total, p, uni = brute(train)
    for shard_tokens in (4_000_000, 500):
        model = kn.train(docs, use=use, shard_tokens=shard_tokens)
        assert model["tokens"] == total and model["words"] == len(uni)
        got = {r.doc_id: r for r in kn.score(docs, model).collect()}
        for i, t, _ in rows:
            n, known, base, own = row(t)
            r = got[i]
            assert (r.n_tokens, r.n_known) == (n, known)
            assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and abs(r.score - own) < 1e-6 * max(1, abs(own))
    # probabilities after a context sum to one over the vocabulary and the unknown word
    assert abs(sum(p("the", w) for w in uni) + p("the", "?") - 1) < 1e-9


def test_no_training_text(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = kn.train(docs.limit(0))
    assert {round(r.score, 9) for r in kn.score(docs, model).collect()} == {0.0}
    assert kn.score(docs.limit(0), kn.train(docs)).count() == 0


def brute_of(order, train):
    """p(history, w) by dictionaries for any order."""
    counts = {order: Counter(g for t in train for g in zip(*[(["<s>"] * (order - 1) + toks(t))[k:] for k in range(order)]))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter()
        for g, n in counts[k + 1].items():
            counts[k][g[1:]] += n if g[1] == "<s>" else 1
    d = {k: kn._discounts([sum(n == m for n in counts[k].values()) for m in (1, 2, 3, 4)]) for k in counts}
    sums, follow = defaultdict(int), defaultdict(Counter)
    for k in counts:
        for g, n in counts[k].items():
            sums[k, g[:-1]] += n
            follow[k, g[:-1]][min(n, 3)] += 1

    def p(h, w):
        k = len(h) + 1
        below = p(h[1:], w) if h else 1 / (len(counts[1]) + 1)
        if not sums[k, h]:
            return below
        c = counts[k][(*h, w)]
        return (max(c - d[k][min(c, 3)], 0) + sum(d[k][m] * n for m, n in follow[k, h].items()) * below) / sums[k, h]
    return p, counts


def test_orders_against_dictionaries(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "of", "a", "b", "c", "zz"], [9, 5, 2, 1, 1, 1], k=rng.randint(0, 80))) for _ in range(60)]
    texts += [None, "", "the of", "unknown words the", "the a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = [t for i, t in enumerate(texts) if i % 5]
    for order, shard_tokens in ((3, 4_000_000), (3, 300), (4, 500)):
        p, counts = brute_of(order, train)
        model = kn.train(docs, use=docs.doc_id % 5 != 0, shard_tokens=shard_tokens, order=order)
        got = {r.doc_id: r.score for r in kn.score(docs, model).collect()}
        for i, t in enumerate(texts):
            w = ["<s>"] * (order - 1) + toks(t)
            want = sum(math.log10(p(tuple(w[k - order + 1:k]), w[k])) for k in range(order - 1, len(w)))
            assert abs(got[i] - want) < 1e-6 * max(1, abs(want))
        total = sum(p(("the",) * (order - 1), w) for (w,) in counts[1]) + p(("the",) * (order - 1), "?")
        assert abs(total - 1) < 1e-9


def test_hashes_are_ordered_like_a_stable_sort():
    import numpy as np
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5000, 70000):
        keys = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        keys[::3], keys[1::7] = keys[:1], keys[:1] ^ np.uint64(1)  # equal ones, and some that differ in the last bit
        for some in (keys, keys >> np.uint64(50)):
            order, ordered = kn._sorted(some)
            want = np.argsort(some, kind="stable")
            assert (order == want).all() and (ordered == some[want]).all()
            distinct, place = kn._distinct(some)
            assert (distinct == np.unique(some)).all() and (distinct[place] == some).all()


def test_bytes_of_a_written_key_and_of_a_rare_word(tmp_path):
    import numpy as np
    keys = np.sort(np.random.default_rng(5).integers(0, 1 << 64, 130000, dtype=np.uint64))
    kn._save_keys(str(tmp_path), "0", keys)
    assert sum(f.stat().st_size for f in tmp_path.iterdir()) < 5.1 * len(keys)  # 4 for the key; 5.5 to 6 in all before
    reader = kn._Reader({"folder": str(tmp_path.parent), "shards": 1})
    other = np.random.default_rng(6).integers(0, 1 << 64, 1000, dtype=np.uint64)
    which, at = reader._places(tmp_path.name, 0, np.concatenate([other, keys]))
    assert sorted(zip(which.tolist(), at.tolist())) == [(1000 + i, i) for i in range(len(keys))]
    nothing = np.zeros(0, np.uint64)
    packed, place = kn._list_words(keys, nothing)
    assert (kn._listed(packed, nothing) == keys).all() and (place == np.arange(len(keys))).all()
    assert len(packed[1]) < 6.6 * len(keys)  # 7 and more before


def test_more_shards_than_files_that_may_be_open(spark):
    import os
    import resource

    import numpy as np
    import pyarrow as pa
    rng = random.Random(7)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{int(rng.expovariate(0.02))}" for _ in range(200)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = kn.train(docs, use=docs.doc_id % 5 != 0, shard_tokens=60, order=3)
    used = len(os.listdir("/proc/self/fd"))
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    assert model["shards"] > 4 * used
    want = {r.doc_id: r.score for r in kn.score(docs, model).collect()}
    (grams, sizes), = kn._batches(pa.array(texts), 3)
    try:
        resource.setrlimit(resource.RLIMIT_NOFILE, (4 * used, hard))
        reader = kn._Reader(model)
        for _ in range(2):
            _, _, _, own = kn._scored(reader, grams, sizes)
            assert np.allclose(own, [want[i] for i in range(len(texts))])
        assert reader.held == reader.most == 2 * used
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
