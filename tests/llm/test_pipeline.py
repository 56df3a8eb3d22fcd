"""The pipeline's stages on a small corpus: decisions, columns, edge cases."""
import random

import corpus_pipeline
from tablescope.llm import mixing


def write(spark, folder, docs, labels, bench):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_dir):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(1, 7)))
    text = lambda n=120: " ".join(word() for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    clean = [text() for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), i) for i, t in enumerate(clean)]
    junk = [" ".join(w + "%%%" for w in text().split()) for _ in range(20)]
    rows += [(100 + i, t, "en", "s0", len(t), 0) for i, t in enumerate(junk)]
    rows += [(200, clean[3], "en", "s1", 1, 0), (201, clean[4] + " and one more", "en", "s2", 1, 0), (3, clean[3], "en", "s0", len(clean[3]), 3)]
    rows += [(300 + i, text(60) + " " + t + " " + text(20), "en", None, 9, 0) for i, t in items]
    rows += [(400, None, None, None, None, None), (401, "", "en", "s0", 0, 0), (402, "too short", "en", "s0", 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long")
    labels = spark.createDataFrame([(r[0], int(not 100 <= r[0] < 200), 0) for r in rows], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    folder = f"{tmp_dir}/corpus"
    write(spark, folder, docs, labels, bench)
    current, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, folder)
        out.write.parquet(f"{tmp_dir}/{name}")
        current = spark.read.parquet(f"{tmp_dir}/{name}")
        seen[name] = sorted(r.doc_id for r in current.select("doc_id").collect())
        if k < 4:
            assert current.columns == docs.columns
    assert set(range(60)) <= set(seen["quality_rules"]) and not set(range(100, 120)) & set(seen["quality_rules"])
    assert not {400, 401, 402} & set(seen["quality_rules"])
    assert set(range(60)) <= set(seen["quality_classifier"])
    assert seen["ngram_jaccard_join"] == [*range(60), *range(300, 305)]
    assert seen["benchmark_decontamination"] == [*range(60)]
    last = spark.read.parquet(f"{tmp_dir}/benchmark_decontamination")
    want = sum(r.copies for r in mixing.taken(last).collect())
    assert current.count() == want > 60 and set(seen["source_mix"]) <= set(range(60))


def test_classifier_learns_from_rows_that_the_rules_dropped(spark, tmp_dir):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    good = [word("aeioustrnl") for _ in range(150)]
    bad = [word("bcdfgmpwkh") + "7,9;" for _ in range(100)] + [f"{i};" for i in range(10, 60)]
    text = lambda words, n=120: " ".join(rng.choice(words) for _ in range(n))
    # labelled junk is too short for the rules; unlabelled junk (500 and up) is of the same kind and passes them
    texts = [text(good) for _ in range(200)] + [text(bad, 45) for _ in range(200)]
    rows = [(i, t, "en", "s0", len(t)) for i, t in enumerate(texts)]
    rows += [(500 + i, t, "en", "s0", len(t)) for i, t in enumerate(text(bad, 60) for _ in range(10))]
    rows += [(600 + i, t, "en", "s0", len(t)) for i, t in enumerate(text(good) for _ in range(10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    folder = f"{tmp_dir}/corpus"
    write(spark, folder, docs, labels, spark.createDataFrame([], "item_id long, text string"))
    corpus_pipeline.rules(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).write.parquet(f"{tmp_dir}/kept")
    kept = spark.read.parquet(f"{tmp_dir}/kept")
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert set(range(500, 510)) <= ids and set(range(600, 610)) <= ids and not ids & set(range(200, 400))
    out = {r.doc_id for r in corpus_pipeline.classifier(spark, kept, folder).collect()}
    assert not out & set(range(500, 510)) and out == {*range(200), *range(600, 610)}


def test_empty_corpus(spark, tmp_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    folder = f"{tmp_dir}/none"
    write(spark, folder, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"),
          spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, folder).count() == 0
