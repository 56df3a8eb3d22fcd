"""Importance resampling against a plain version, quickselect on ties, edge cases."""
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tablescope.llm import resampling as rs


def plain_features(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=5, min_words=20):
    s, t = [0] * 10000, [0] * 10000
    for into, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for b in plain_features(text)[1]:
                into[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000.0) / ((s[b] + 1.0) * (big_t + 10000.0)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        n, f = plain_features(text)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    pool = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(pool[:percent * len(pool) // 100]):
        r[4] = i + 1
    return sorted(map(str, (tuple(r[:5]) for r in rows)))


def got(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def corpus():
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "été", "x1", "ÄRGER", "don't", "日本語", "a_b", "z" * 70, "İs", "q"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    docs += [(7, "same words " * 30), (7, "same words " * 30), (None, "no id here " * 9), (-3, None), (401, ""), (402, "\n\t ...")]
    docs += [(500, "long text, with Words. " * 90_000), (501, "w" * 300_000 + " end")]
    return docs, ["alpha beta x1 " * 20, "été, été", None]


@pytest.mark.parametrize("percent", [5, 100])
def test_equals_plain(spark, percent):
    docs, target = corpus()
    df = spark.createDataFrame([(i, t, 1.0, "r") for i, t in docs], "doc_id long, text string, score double, rank string")
    bench = spark.createDataFrame([(t, 9) for t in target], "text string, weight int")
    assert got(rs.resample(df, bench, percent=percent)) == plain(docs, target, percent)


def test_slices_carry_words(spark, monkeypatch):
    monkeypatch.setattr(rs.ta, "SLICE", 64)
    import pyarrow as pa
    texts = [t for _, t in corpus()[0][:200]]
    at = {}
    for i, j, counts, parts in rs.features(pa.array(texts)):
        for doc, bucket in parts:
            for d, b in zip(doc, bucket):
                at.setdefault(i + int(d), []).append(int(b))
        for d, n in enumerate(counts):
            assert n == plain_features(texts[i + d])[0]
    for d, text in enumerate(texts):
        assert sorted(at.get(d, [])) == sorted(plain_features(text)[1])


def test_quickselect_with_ties(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([5, 5, 5, 6, -1]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, score long, _place long")
    order = sorted((-s, (1 << 63) - 1 if d is None else d, p) for d, s, p in rows)
    for k in (1, 2, 350, 699, 700):
        assert rs.kth_key(df, k, pivots=3) == order[k - 1]
    with pytest.raises(ValueError):
        rs.kth_key(df, 701)
    ranks = rs.ranked(df).orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 701))
    assert [r["_place"] for r in ranks] == [p for _, _, p in order]


def test_empty_and_rows(spark):
    schema = "doc_id long, text string"
    none = spark.createDataFrame([], schema)
    assert rs.resample(none, none).count() == 0
    docs, target = corpus()
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], schema + ", drawn string")
    assert got(rs.resample(df, none)) == plain(docs, [])
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    kept = rs.drawn_rows(df, bench)
    ids = {r.doc_id for r in rs.resample(df, bench).where("rank IS NOT NULL").collect()}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == ids
    assert rs.resample(df.where(F.lit(False)), bench).count() == 0
