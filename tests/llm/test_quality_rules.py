"""Quality rules: counts against brute force, verdicts, edge cases."""
import re
from collections import Counter

import pytest

from tablescope.llm import quality_rules

PROSE = ("It was a mild day and the old men of the town sat on the wall by the sea to talk of the rain that had come "
         "in the night. One of them had a dog that ran to and fro on the sand and would not come to his call at all. "
         "At noon the sun came out and they went home to eat.")
LONG = PROSE + "\n" + " ".join(w for i, w in enumerate(PROSE.split()) if i % 3)
JUNK = " ".join(f"{w}%%%" for w in LONG.split())


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


@pytest.fixture(scope="module")
def rows():
    texts = [LONG, JUNK, None, "", " \n\t", "a", "a b c", "a b c a b c", "x y x y x y x y", LONG, "é ü z a#b|c",
             "line\n\nline\n line\nline", "same words " * 40, "\x0b\x0cw\r\nw", " ".join(str(i % 977) for i in range(30_000))]
    return [(i if i != 9 else 0, t, "x", 1.0, True) for i, t in enumerate(texts)] + [(None, "no id here", None, None, None)]


def test_counts_and_verdicts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, posterior string, n_words double, kept boolean")
    got = quality_rules.score(docs).collect()
    want = Counter((r[0], *brute(r[1])) for r in rows)
    assert Counter((r.doc_id, *(r[c] for c in quality_rules.COUNTS)) for r in got) == want
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    by = {r.doc_id: r for r in got}
    assert by[0].kept and not by[1].kept and not by[2].kept


def test_filter_rows_keeps_columns_and_repeats(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, posterior string, n_words double, kept boolean")
    out = quality_rules.filter_rows(docs)
    assert out.columns == docs.columns
    assert [r.doc_id for r in out.collect()].count(0) == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.score(docs).count() == 0
    assert quality_rules.filter_rows(docs).count() == 0


def test_more_than_a_million_words(spark):
    """Windows that stand twice among 1.2 million words, in a text whose hashes no longer fit beside their positions."""
    import random
    import time
    rng = random.Random(3)
    words = [f"w{rng.randrange(10 ** 9)}" for _ in range(1_200_000)]
    words[700_000:700_005] = words[100:105]
    words[900_000:900_003] = words[100:103]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    started = time.time()
    row = quality_rules.score(docs).first()
    assert (row.n_words, row.n_repeat_words) == (1_200_000, 5 + 5 + 3) and time.time() - started < 120


def test_em_and_posteriors_against_a_plain_version(spark, rows):
    import math
    docs = spark.createDataFrame(rows, "doc_id long, text string, posterior string, n_words double, kept boolean")
    got = quality_rules.score(docs).collect()
    rules = quality_rules.RULES
    votes = [[r[f"vote_{x}"] for x in rules] for r in got]
    model = [quality_rules.START] * len(rules)

    def posterior(v):
        odds = sum(x * math.log(a / (1 - a)) for x, a in zip(v, model))
        return 1 / (1 + math.exp(-odds))
    for _ in range(quality_rules.EM_ROUNDS):
        new = []
        for k in range(len(rules)):
            cast = [v for v in votes if v[k]]
            right = sum(posterior(v) if v[k] == 1 else 1 - posterior(v) for v in cast)
            pull = quality_rules.PULL * len(cast) + 1
            new.append(min(quality_rules.BEST, max(quality_rules.WORST, (right + pull * quality_rules.START) / (len(cast) + pull))))
        moved = max(abs(a - b) for a, b in zip(new, model))
        model = new
        if moved < 1e-4:
            break
    for r, v in zip(got, votes):
        assert abs(r.posterior - posterior(v)) < 1e-9
        assert r.kept == (not r.base_failed and posterior(v) >= quality_rules.THRESHOLD)


def test_rounds_have_small_plans(spark, monkeypatch):
    """The driver keeps every round's plan: none has a shuffle, and the posterior stands in it once, not once a rule."""
    votes = [[(k * (r + 2)) % 3 - 1 for r in range(len(quality_rules.RULES))] for k in range(30)]
    patterns = spark.createDataFrame([(k + 1, *v) for k, v in enumerate(votes)], "n long, " + ", ".join(f"{r} int" for r in quality_rules.RULES))
    plans = []
    first = type(patterns).first
    monkeypatch.setattr(type(patterns), "first", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or first(self))
    model = quality_rules._fit(patterns.repartition(4), quality_rules.RULES, 3)
    assert set(model) == set(quality_rules.RULES) and len(plans) == 3
    assert all("SinglePartition" not in x and x.lower().count("exp(") == 1 for x in plans)
