"""Near-duplicate join against brute force, blocks, edge cases."""
import random
import re
from collections import defaultdict

from tablescope.llm import graph, ngram_join


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[i:i + 5]) for i in range(len(w) - 4)) or (frozenset([" ".join(w)]) if w else frozenset())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    kinds = sorted({s for s in sets if s}, key=sorted)
    parent = {s: s for s in kinds}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    links = defaultdict(int)
    for i, a in enumerate(kinds):
        for b in kinds[i + 1:]:
            if len(a & b) * 1.8 >= 0.8 * (len(a) + len(b)) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for (d, _), s in zip(rows, sets):
        if s and d is not None:
            ids[find(s)].append(d)
    return sorted(((d, min(ids[find(s)], default=None) if s else d, links[s] if s else 0, sets.count(s) if s else 1)
                   for (d, _), s in zip(rows, sets)), key=str)


def corpus(n=80):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for d in range(n):
        base = [word() for _ in range(rng.randint(3, 90))]
        rows.append((len(rows), " ".join(base) + (" " + passage if d % 4 == 0 else "")))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = base[:]
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    hot = [word() for _ in range(120)]
    for k in range(60):
        copy = hot[:]
        for _ in range(k % 3):
            copy[rng.randrange(len(copy))] = word()
        rows.append((len(rows), " ".join(copy)))
    rows += [(9000, None), (9001, ""), (9002, "  \n"), (9003, "a b"), (9004, "A  b"), (9005, "a b c"), (9006, rows[0][1]),
             (9006, rows[0][1]), (None, rows[0][1]), (None, "only here without an id at all, really"), (9010, "x " * 30_000)]
    return rows


def test_groups(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, node string")
    for options in ({}, {"block_rows": 16}):
        got = ngram_join.groups(docs, **options).select("doc_id", "class_id", "n_links", "n_copies").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {r[1] for r in brute(rows) if r[1] is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == want and len(ids) == len(want) + 1


def test_depth_and_empty(spark):
    depth = ngram_join.depth_for(0.8, 20, 0.999)
    assert 1 - (1 - 0.8 ** depth) ** 20 >= 0.999 > 1 - (1 - 0.8 ** (depth + 1)) ** 20
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.groups(none).count() == 0 and ngram_join.one_of_each(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 105), (105, 103), (7, 7), (50, 40)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 105: 100, 103: 100, 50: 40, 40: 40}


def test_components_in_few_tables(spark, monkeypatch):
    """Stars take no round, and the last round is seen to be the last; tables stand for rounds, each of which the driver plans."""
    kept = []
    monkeypatch.setattr(graph, "written", lambda df, name, f=graph.written: kept.append(name) or f(df, name))
    stars = [(5, 1), (7, 1), (9, 2), (9, 9)]
    got = sorted(map(tuple, graph.components(spark.createDataFrame(stars, "u long, v long")).collect()))
    assert got == [(1, 1), (2, 2), (5, 1), (7, 1), (9, 2)] and len(kept) == 1
    got = sorted(map(tuple, graph.components(spark.createDataFrame([(1, 2), (3, 2), (None, 4)], "u long, v long")).collect()))
    assert got == [(1, 1), (2, 1), (3, 1)] and len(kept) == 3


def test_forest_has_stars(spark):
    """What shares a prefix hangs together at every depth, at a few first signatures."""
    rng = random.Random(5)
    labels = {n: bytes(x for _ in range(3) for x in (0, rng.choice([1, 1, 1, 2]))) for n in rng.sample(range(10 ** 6), 3000)}
    classes = spark.createDataFrame([(n, bytearray(x)) for n, x in labels.items()], "node long, labels binary")
    for size in (10_000, 64):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = [tuple(r) for r in ngram_join.forest(classes, 1, 3, 1).collect()]
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for d in (1, 2, 3):
            parent = {n: n for n in labels}

            def find(n):
                while parent[n] != n:
                    n = parent[n]
                return n

            for u, v, lcp in got:
                assert labels[u][:2 * lcp] == labels[v][:2 * lcp]
                if lcp >= d:
                    parent[find(u)] = find(v)
            kinds = {labels[n][:2 * d] for n in labels}
            assert len({find(n) for n in labels}) == len(kinds) == len({(find(n), labels[n][:2 * d]) for n in labels})
        assert len({v for _, v, _ in got}) < 200
