"""Shared helpers: the join that is safe for hot keys, fresh names, words."""
from pyspark.sql import functions as F

from tablescope.llm.common import fresh, held_out, join_hot, words


def test_join_hot(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 50}") for i in range(3000)] + [(1, None)], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("other", 3)], "k string, v int")
    for how in ("left", "inner", "left_anti"):
        want = left.join(right, "k", how)
        got = join_hot(left, right, "k", how)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert join_hot(left.limit(0), right, "k", "left").count() == 0


def test_names_words_and_folds(spark):
    df = spark.createDataFrame([(1, " a\tb\x0bc  "), (2, None), (None, "\n")], "_key long, text string")
    assert fresh(df, "key", "KEY") == ["_key_1", "_KEY_2"] or fresh(df, "key") == ["_key_1"]
    assert [list(r[0]) for r in df.select(words(F.col("text"))).collect()] == [["a", "b", "c"], [], []]
    import zlib
    got = [r[0] for r in df.select(held_out(F.col("_key"), 4, 2)).collect()]
    assert got == [zlib.crc32(t) % 4 == 2 for t in (b"1", b"2", b"")]
