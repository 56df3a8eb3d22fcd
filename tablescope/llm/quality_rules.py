"""Quality rules by weak supervision, in DataFrame functions only.

Rules look at counts of a whole text and vote for it (1), against it (-1) or
abstain (0). How far each rule can be trusted is not fixed by hand: expectation
maximisation over the table of vote patterns (at most 2^rules rows, whatever the
number of documents) estimates every rule's accuracy. The posterior probability of a document
follows from its pattern, so the text is read once and the posteriors come back
by a join on the pattern.

Edge cases: a null or empty text has no words, fails the base rule and is not
kept; very long texts are counted whole; a posterior right at the threshold keeps the document; repeated rows are scored alike, each on its own; an empty table gives an
empty result; other columns, also such with the names of results, do not matter
to ``score`` (it returns its own columns) and are kept as they are by ``filter_rows``.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import prepare, words, written

RULES = ("length", "symbols", "capitals", "shouting", "short_words", "word_length", "repeated_lines", "repeated_words",
         "prose")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
EM_ROUNDS = 60
THRESHOLD = 0.5
#: Share of good documents before any vote; a rule's accuracy to start from, its weight in votes, and the accuracy's bounds.
BALANCE = 0.5
START = 0.8
PULL = 0.5
WORST, BEST = 0.55, 0.99

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column, n: Column) -> Column:
    """Words that stand in a 3-word window found twice or more, for the word array ``w`` of ``n`` words.

    The windows' 64-bit hashes are packed with their position into one long and
    sorted as primitives, so equal windows become neighbours; neighbours are then
    compared by the full hash. Where two different windows share the packed bits
    (rare, but not in texts of a million words) pairs of full hash and position are sorted instead.
    """
    hashes = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
                         lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def with_hashes(h: Column) -> Column:
        low = F.when(n < (1 << 20), F.lit((1 << 20) - 1)).otherwise(F.lit((1 << 31) - 1)).cast("long")

        def full(p: Column) -> Column:
            return F.get(h, p.bitwiseAND(low).cast("int"))

        def marked(s: Column) -> Column:
            return F.filter(s, lambda p, j: (full(p) == F.coalesce(full(F.get(s, j - 1)), F.lit(0)))
                            & (j > 0) | (full(p) == full(F.get(s, j + 1))) & (j + 1 < F.size(s)))

        def mixed(s: Column) -> Column:
            return F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda j: (
                full(F.get(s, j)) != full(F.get(s, j - 1)))
                & (F.get(s, j).bitwiseXOR(F.get(s, j - 1)) <= low)
                & (F.get(s, j).bitwiseXOR(F.get(s, j - 1)) >= 0))

        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
        def twice(s: Column) -> Column:
            """Positions of pairs (hash, position), sorted, with a neighbour of the same hash."""
            def same(e: Column, j: Column) -> Column:
                before, after = F.get(s, j - 1), F.get(s, j + 1)
                return F.coalesce((j > 0) & (before["x"] == e["x"]), F.lit(False)) | F.coalesce(after["x"] == e["x"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        positions = _let(packed, lambda s: F.when(mixed(s), _let(pairs, twice)).otherwise(F.sort_array(F.transform(marked(s), lambda p: p.bitwiseAND(low).cast("int")))))
        covered = _let(positions, lambda q: F.aggregate(
            F.transform(q, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(q, i + 1) - x, F.lit(3)))),
            F.lit(0).cast("long"), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered)

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_let(hashes, with_hashes))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, the counts, n_lines, n_letters, n_upper, n_short, n_shout), one row per input row."""
    return _counted(docs, F.col(f"`{id_col}`"), id_col, text_col)


def _counted(docs: DataFrame, carry: Column, carry_as: str, text_col: str) -> DataFrame:
    """The counts of every row beside the column ``carry``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    step = docs.select(carry.alias(carry_as), text.alias("_t"), words(text).alias("_w"))
    id_col = carry_as
    step = step.select(id_col, "_t", "_w", F.size("_w").alias("_n"),
                       F.array_join("_w", "").alias("_joined"),
                       F.filter(F.split("_t", "\n", -1),
                                lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0).alias("_lines"))
    letters = F.col("_joined")
    return step.select(
        id_col,
        F.col("_n").cast("long").alias("n_words"),
        F.length("_joined").cast("long").alias("word_chars"),
        (F.size(F.split(letters, r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w"), F.col("_n")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(letters, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        (F.size(F.split(letters, "!", -1)) - 1).cast("long").alias("n_shout"),
        F.size(F.filter("_w", lambda x: F.octet_length(x) <= 3)).cast("long").alias("n_short"),
    )


def votes() -> dict[str, Column]:
    """Each rule's vote over the columns of ``text_counts``: 1 for, -1 against, 0 abstains.

    Shares are compared in whole numbers. ``prose`` is the one rule that votes for
    a text: its words look like running text. The others only object.
    """
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    against = {
        "length": n < MIN_WORDS,
        "symbols": F.col("n_symbols") * 10 > n,
        "capitals": F.col("n_upper") * 10 > chars * 3,
        "shouting": F.col("n_shout") * 5 > n,
        "short_words": F.col("n_short") * 20 < n,
        "word_length": (chars < n * 2) | (chars > n * 10),
        "repeated_lines": F.col("n_dup_lines") * 10 > lines * 3,
        "repeated_words": F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT,
    }
    prose = ((n > 0) & (F.col("n_symbols") * 50 <= n) & (F.col("n_upper") * 5 <= chars) & (F.col("n_shout") * 50 <= n)
             & (F.col("n_short") * 10 >= n) & (chars >= n * 3) & (chars <= n * 9))
    out = {r: F.when(c & (n > 0) | F.lit(r == "length") & c, F.lit(-1)).otherwise(F.lit(0)) for r, c in against.items()}
    return out | {"prose": F.when(prose, F.lit(1)).otherwise(F.lit(0))}


def _fit(patterns: DataFrame, rules: tuple[str, ...], rounds: int) -> dict[str, float]:
    """EM over the pattern table; each round is one aggregate of it, the accuracies come back as literals.

    The table has at most 2^(rules + 1) rows, so a round is one task without a shuffle. Its posterior is a column
    of its own, named once: the driver keeps every round's plan and the code made for it.

    E step: every pattern's posterior; M step: a rule's accuracy is the posterior
    share of the documents it voted on where its vote is right, pulled to START
    with the weight of PULL of them and kept above chance.
    """
    model = dict.fromkeys(rules, START)
    patterns = patterns.coalesce(1)
    p, weight = F.col("_p"), F.col("n").cast("double")
    for _ in range(rounds):
        sums = [F.sum(weight).alias("all")]
        for r in rules:
            right = F.when(F.col(r) == 1, p).when(F.col(r) == -1, 1 - p).otherwise(0.0)
            sums += [F.sum(weight * right).alias(f"{r}_right"),
                     F.sum(F.when(F.col(r) != 0, weight).otherwise(0.0)).alias(f"{r}_all")]
        row = patterns.withColumn("_p", _posterior(model, rules)).agg(*sums).first()
        if not row["all"]:
            break
        new = {}
        for r in rules:
            pull = PULL * row[f"{r}_all"] + 1
            new[r] = min(BEST, max(WORST, (row[f"{r}_right"] + pull * START) / (row[f"{r}_all"] + pull)))
        moved = max(abs(new[r] - model[r]) for r in rules)
        model = new
        if moved < 1e-4:
            break
    return model


def _posterior(model: dict[str, float], rules: tuple[str, ...]) -> Column:
    """Posterior probability of a good document from its votes; an abstention says nothing."""
    # an array of numbers, unlike single ones, is no part of the generated code, which so is made once for all models
    each = F.zip_with(F.array(*[F.col(r) for r in rules]), F.array(*[F.lit(math.log(model[r] / (1 - model[r]))) for r in rules]),
                      lambda vote, odds: vote * odds)
    odds = F.aggregate(each, F.lit(math.log(BALANCE / (1 - BALANCE))), lambda a, x: a + x)
    return 1 / (1 + F.exp(-odds))


def _base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)


def _pattern() -> Column:
    """All votes and the base rule as one small number, two bits each."""
    out = F.when(_base_failed(), 4 ** len(RULES)).otherwise(0)
    for k, (r, vote) in enumerate(votes().items()):
        out = out + (vote + 1) * (4 ** k)
    return out


def fit(rated: DataFrame, rounds: int = EM_ROUNDS) -> DataFrame:
    """(pattern, n, failed, vote_<rule>, posterior) of every vote pattern in a table with a ``pattern`` per document."""
    patterns = rated.groupBy("pattern").agg(F.count("*").alias("n")).select(
        "pattern", "n", (F.col("pattern") >= 4 ** len(RULES)).alias("failed"),
        *[(F.pmod(F.floor(F.col("pattern") / (4 ** k)), F.lit(4)) - 1).cast("int").alias(r) for k, r in enumerate(RULES)])
    patterns = written(patterns, "rule-patterns")
    model = _fit(patterns, RULES, rounds)
    return patterns.select("pattern", "n", "failed", *[F.col(r).alias(f"vote_{r}") for r in RULES],
                           _posterior(model, RULES).alias("posterior"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = EM_ROUNDS,
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, counts, base_failed, each rule's vote, posterior and the verdict ``kept``."""
    prepare(docs.sparkSession)
    rated = written(text_counts(docs, id_col, text_col).select(id_col, *COUNTS, _pattern().alias("pattern")), "rule-votes")
    # at most 2^(rules + 1) patterns
    scored = rated.join(F.broadcast(fit(rated, rounds)), "pattern")
    return scored.select(id_col, *COUNTS, F.col("failed").alias("base_failed"), *[f"vote_{r}" for r in RULES], "posterior",
                         (~F.col("failed") & (F.col("posterior") >= threshold)).alias("kept"))


def filter_rows(docs: DataFrame, text_col: str = "text", rounds: int = EM_ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are.

    The texts are read twice, once for the pattern table and once for the verdict,
    so that no row is shuffled.
    """
    prepare(docs.sparkSession)
    model = fit(text_counts(docs, docs.columns[0], text_col).select(_pattern().alias("pattern")), rounds)
    rated = _counted(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "_row", text_col)
    rated = rated.select("_row", _pattern().alias("pattern"))
    # at most 2^(rules + 1) patterns; as a join, so that the counts are not repeated in a filter's expression
    good = model.where(~F.col("failed") & (F.col("posterior") >= threshold)).select("pattern")
    kept = rated.join(F.broadcast(good), "pattern", "left_semi")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
