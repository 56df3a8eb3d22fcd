"""License scan against brute force, edge cases."""
import random
import re

from tablescope.llm import license_scan as ls


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = tokens(text)
    places = [(i, label) for phrase, label in ls.PHRASES.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    own, labels, best = {x for _, x in places}, {x for _, x in places}, 0.0
    for b in range(0, max(1, len(w)), ls.BLOCK // 2):
        block = set(w[b:b + ls.BLOCK])
        for label, template in ls.TEMPLATES:
            t = set(tokens(template))
            if len(t & block) >= ls.CONTAINMENT * len(t) - 1e-9:
                labels.add(label)
                best = max(best, len(t & block) / len(t))
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
            ",".join(sorted(labels)), 1.0 if places else best)


def test_scan(spark):
    rng = random.Random(7)
    vocabulary = ["the", "of", "license", "under", "mit", "cc", "by", "all", "rights", "reserved", "general", "public", "é", "x1",
                  "apache", "licensed", "version", "2", "0", "gnu", "work", "this", "is"]
    texts = [None, "", "   ", "CC-BY", "cc by cc by", "all rights\nreserved", "All RIGHTS, reserved. all rights", "Ccé by",
             "GNU General Public License"] + [t for _, t in ls.TEMPLATES]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    texts += [" ".join(["pad"] * 50) + " released under the new MIT License " + " ".join(["pad"] * 40_000)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(4, texts[4], "again"), (None, "cc by", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = sorted((tuple(r)[:7] + (round(r.score, 9),) for r in ls.scan(docs).collect()), key=str)
    want = sorted(((i, *brute(t)[:6], round(brute(t)[6], 9)) for i, t, _ in rows), key=str)
    assert got == want
    assert ls.scan(docs.limit(0)).count() == 0


def test_long_templates(spark):
    """A template of a thousand words in a text of its own, with a tenth of its words replaced, and with a third."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(1000)]
    template = " ".join(words)

    def changed(share):
        return " ".join(f"x{i}" if rng.random() < share else w for i, w in enumerate(words))
    pad = " ".join(["pad"] * 777)
    rows = [(1, f"{pad} {changed(0.1)} {pad}"), (2, changed(0.33)), (3, f"{pad} released under the mit license"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.labels for r in ls.scan(docs, templates=[("long", template), ("mit", "Released under the MIT License"), ("none", "")]).collect()}
    assert got == {1: "long", 2: "", 3: "mit", 4: ""}
