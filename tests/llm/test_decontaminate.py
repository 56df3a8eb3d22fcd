"""Spaced seeds: sensitivity of the masks, planted leaks, edge cases."""
import itertools
import random

from tablescope.llm import decontaminate as dc


def test_masks_see_every_window_with_two_substitutions():
    for subs in itertools.combinations(range(dc.WINDOW), dc.WINDOW - dc.NEED):
        assert any(not set(subs) & {o + p for p in m} for m in dc.MASKS for o in range(dc.WINDOW - m[-1]))


def brute(doc, item):
    if not item:
        return False
    n = min(dc.WINDOW, len(item))
    need = -(-n * dc.NEED // dc.WINDOW)
    for shift in range(-len(item), len(doc)):
        equal = [0 <= shift + j < len(doc) and doc[shift + j] == x for j, x in enumerate(item)]
        if any(sum(equal[o:o + n]) >= need for o in range(len(item) - n + 1)):
            return True
    return False


def test_leaks_match_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + str(rng.randint(0, 9))
    items = [(i, " ".join(word() for _ in range(rng.randint(13, 40)))) for i in range(20)] + [
        (90, "too short"), (91, None), (92, ""), (0, None), (95, "quite exactly five words, here"), (96, "three small words")]
    items += [(93, items[3][1]), (94, "Mixed CASE, with? punctuation! in (the) item and a few words more so.")]
    docs = []
    for d in range(120):
        words = [word() for _ in range(rng.randint(0, 60))]
        if d % 2:
            x = items[rng.randint(0, 19)][1].split()
            part = x[:] if d % 4 == 1 else x[rng.randint(0, 5):][:rng.randint(8, 20)]
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = word()
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((d, " ".join(words), "x", 1))
    docs += [(200, None, None, 0), (201, "", None, 0), (5, docs[5][1], "y", 2), (None, items[2][1], "z", 3),
             (202, "Say: mixed case with punctuation in the ITEM and a few words more so.", "x", 1),
             (203, " ".join(["same"] * 5000) + " " + items[1][1], "x", 1), (204, "a " * 20 + "quite exactly five words here", "x", 1),
             (205, "quite exactly four words here", "x", 1), (206, "Three; small WORDS", "x", 1), (207, "it is too short", "x", 1),
             (208, "three small", "x", 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, hash string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(table, bench).collect()}
    tok = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
    want = {(d[0], i) for d in docs for i, t in items if brute(tok(d[1]), tok(t))}
    assert got == want and (202, 94) in got and (None, 2) in got and {(204, 95), (206, 96), (207, 90)} <= got
    whole = sorted(map(str, dc.leaks(table, bench).collect()))
    assert whole == sorted(map(str, dc.leaks(table, bench, broadcast_seeds=0).collect()))
    kept = dc.clean_rows(table, bench)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in docs if d[0] not in {k for k, _ in want})
    assert dc.leaks(table.limit(0), bench).count() == 0 and dc.clean_rows(table, bench.limit(0)).count() == len(docs)


def test_a_long_text_with_many_hits(spark):
    """55 hits in each of 1000 passages: as rows with the whole text they would take over 50 GB."""
    passage = [f"word{i}x{i * i}" for i in range(40)]
    table = spark.createDataFrame([(1, " ".join(passage * 1000)), (2, " ".join(["before", *passage[3:30]])), (3, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(passage)), (8, " ".join(passage[:12])), (None, " ".join(passage))], "item_id long, text string")
    for seeds in (dc.BROADCAST_SEEDS, 0):
        got = sorted(tuple(r) for r in dc.leaks(table, bench, broadcast_seeds=seeds).collect())
        assert got == [(1, 7, 0, 13, 13), (1, 8, 0, 12, 12), (2, 7, 1, 13, 13)]
    assert [r.doc_id for r in dc.clean_rows(table, bench).collect()] == [3]
