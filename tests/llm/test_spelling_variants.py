"""Spelling variants against a plain version: vocabulary, near words, forms and roots."""
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tablescope.llm import spelling_variants as sv


def plain_vocabulary(docs, drop_every=199, min_length=6, min_count=5):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def plain_near(n):
    words, by_length = sorted(n), defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    return {w: [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if one_edit(w, v)] for w in words}


def plain(n, ratio=5):
    near, form, out = plain_near(n), {}, []
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    for w in n:
        end = w
        while form[end]:
            end = form[end]
        out.append(str((w, form[w], end, n[w], len(near[w]), n[form[w]] if form[w] else None)))
    return sorted(out)


def corpus(seed=4):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    docs = []
    for i in range(500):
        words = []
        for _ in range(rng.randint(0, 120)):
            w = rng.choice(base[:6]) if rng.random() < 0.4 else rng.choice(base)
            if rng.random() < 0.25:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", w[at] + "y"]) + w[at + 1:]
            words.append(w.upper() if rng.random() < 0.2 else w)
        docs.append((i, rng.choice([" ", ", ", "1", "\n", "日"]).join(words)))
    docs += [(3, None), (4, ""), (None, "without identity " * 8), (5, "×÷ÀÿþÞ ĀbcdefĀ " * 6), (5, "×÷ÀÿþÞ ĀbcdefĀ " * 6)]
    docs += [(600, "Longer words here, " * 60_000), (601, ("q" * 30_000 + " ") * 5 + ("q" * 29_999 + " ") * 30)]
    return docs


def test_equals_plain(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    got = sorted(str(tuple(r)) for r in sv.group_variants(df, drop_every=199).collect())
    assert got == plain(plain_vocabulary(docs))


def test_slices_do_not_split_words(spark, monkeypatch):
    monkeypatch.setattr(sv, "SLICE", 16)
    text = corpus()[1][1] + " " + "ab" * 30 + "é." * 20
    total = Counter()
    for found in sv.runs(text):
        total.update(found)
    assert {w.decode("latin-1"): n for w, n in total.items()} == plain_vocabulary([(0, text)], None, 0, 1)


@pytest.mark.parametrize("letters,length,count", [("ab", 6, 64), ("ab", 9, 400), ("abcdefgh", 6, 3000)])
def test_scan_finds_all_pairs(letters, length, count):
    """All pairs whose halves agree, over words of which nearly all are near others."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(length, length + 3))) for _ in range(count)})
    keys = [b"f" + w.encode() for w in words]
    got = sorted(sv.scan(keys, keys))
    want = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words)
            if abs(len(a) - len(b)) < 2 and one_edit(a, b) and a[:len(a) // 2] == b[:len(a) // 2]]
    assert got == want


def test_matrix_parts_do_not_change_pairs(monkeypatch):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(6, 30))) for _ in range(500)})
    keys = [b"f" + w.encode() for w in words]
    whole = sorted(sv.scan(keys, keys))
    monkeypatch.setattr(sv, "MATRIX_BYTES", 256)
    assert sorted(sv.scan(keys, keys)) == whole


def test_many_blocks_and_parts(spark, tmp_dir):
    """Half the words share their first letters, so one stretch of blocks is visited by many words."""
    rng = random.Random(9)
    n = {}
    for _ in range(1500):
        w = ("common" if rng.random() < 0.5 else "") + "".join(rng.choice("abcé") for _ in range(rng.randint(6, 8)))
        n[w] = rng.choice([5, 5, 30, 200, 2000])
    spark.createDataFrame(list(n.items()), "word string, n long").write.parquet(tmp_dir + "/words")
    words = spark.read.parquet(tmp_dir + "/words")
    near = plain_near(n)
    want = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-n[v], v))
            want[w] = (len(others), n[best], best)
    got = {r.word: (r.n_near, r.form_n, r.form) for r in sv.near_words(words, block_words=60, visitors=25).collect()}
    assert got == want


def test_roots_of_long_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w5"), ("b", "c")]
    got = {r.word: r.root for r in sv.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: "c" if w == "b" else "w37" for w, _ in links}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sv.group_variants(none).count() == 0
    assert sv.group_variants(spark.createDataFrame([(1, None), (2, "rare words only")], "doc_id long, text string")).count() == 0
