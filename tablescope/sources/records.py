"""Records of delimited text with quoted cells, found by blocks in parallel.

Whether a line end ends a record depends on all quotes before it. Read along one
line, the state (outside a quoted cell, or inside one) at the line's end is a function
of the state at its beginning, and so for any run of lines: a pair of states. Pass one
(``block_facts``) runs both cases over every block, that is over every split of a file, side by
side, for every candidate separator and, to choose one, with quotes that may stand behind any of them. A window over the blocks of a file then composes these
functions from the file's first block on (``file_facts``), so each block's true first state is known and,
with it, the exact counts: separators outside quotes, cells of the widest record also
where a record reaches over blocks, and whether any cell holds a line end.
Pass two (``records``) reads the blocks again, each from its true state, and puts the
lines of a record together; only the pieces of records that cross a block's end
are shuffled.

A quote opens a cell only as the cell's first character; in a quoted cell a doubled
quote is a quote, and a closed cell goes on to the next separator. A quote elsewhere
(an inch mark) is a character. A file whose last quoted cell is never closed has
no multi-line records: each of its lines is one.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = (",", ";", "\t", "|")
_MARK = b"\xef\xbb\xbf"
OUT, IN = 0, 1

#: Facts of a block, by candidate and first state; the candidate behind the last one stands for all of them.
_FACTS = ("file bigint, block bigint, cand int, start int, last int, best bigint, head bigint, tail bigint, multi boolean, "
          "bad boolean, lines bigint, hits array<bigint>, seps array<bigint>")


def line_end(pieces: list[bytes], seps: tuple[bytes, ...], state: int) -> tuple[int, list[int]]:
    """(state after a line, how often each separator stands outside quotes) of a line split at its quotes."""
    inside, closed, at_start, counts = state == IN, False, True, [0] * len(seps)
    final = len(pieces) - 1
    for k, text in enumerate(pieces):
        if inside:
            if k == final:
                return IN, counts
            inside, closed = False, True
            continue
        if closed and not text and k < final:
            inside, closed = True, False  # a doubled quote
            continue
        counts = [n + text.count(s) for n, s in zip(counts, seps)]
        if k < final:
            # the next quote opens a cell if nothing of the cell stands before it
            inside = text.endswith(seps) or (at_start and not text and not closed)
        closed = False
        at_start = False
    return OUT, counts


class _Case:
    """Facts of a block for one candidate and first state, by the separators of the records that end in it: the first
    (``head``, which may have begun before), the most of the others (``best``), and those of the record left open (``tail``)."""

    def __init__(self, sep: bytes, state: int):
        self.sep, self.start, self.state = (sep,), state, state
        self.tail, self.best, self.head = 0, -1, -1
        self.multi = state == IN

    def lines(self, counts: np.ndarray) -> None:
        """A run of lines without quotes, by their separators."""
        if self.state == IN:
            return
        self._end(self.tail + int(counts[0]))
        if len(counts) > 1:
            self.best = max(self.best, int(counts[1:].max()))

    def _end(self, seps: int) -> None:
        if self.head < 0:
            self.head = seps
        else:
            self.best = max(self.best, seps)
        self.tail = 0

    def quoted(self, pieces: list[bytes]) -> None:
        self.state, (seps,) = line_end(pieces, self.sep, self.state)
        if self.state == IN:
            self.tail += seps
            self.multi = True
        else:
            self._end(self.tail + seps)

    def row(self) -> tuple:
        return self.start, self.state, self.best, self.head, self.tail, self.multi, 0, [], []


class _Sniffer:
    """Lines that are not wholly inside a quoted cell, and how many have each separator outside quotes, and how often."""

    def __init__(self, seps: tuple[bytes, ...], state: int):
        self.all, self.start, self.state, self.n = seps, state, state, 0
        self.hits, self.seps = np.zeros(len(seps), np.int64), np.zeros(len(seps), np.int64)

    def _add(self, counts: np.ndarray) -> None:
        self.n += len(counts)
        self.hits += (counts > 0).sum(axis=0)
        self.seps += counts.sum(axis=0)

    def lines(self, counts: np.ndarray) -> None:
        if self.state == OUT:
            self._add(counts)

    def quoted(self, pieces: list[bytes]) -> None:
        before = self.state
        self.state, counts = line_end(pieces, self.all, before)
        if before == OUT or self.state == OUT or any(counts):
            self._add(np.array([counts]))

    def row(self) -> tuple:
        return self.start, self.state, -1, -1, 0, False, self.n, self.hits.tolist(), self.seps.tolist()


def _segments(file: np.ndarray, block: np.ndarray):
    """Runs of rows of the same file and block."""
    if not len(file):
        return
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    edges = [0, *cuts.tolist(), len(file)]
    yield from zip(edges[:-1], edges[1:])


def _plain(lines: pa.Array) -> pa.Array:
    """Lines without the carriage return of a Windows line end."""
    return pc.if_else(pc.ends_with(lines, b"\r"), pc.binary_slice(lines, 0, -1), lines)


def _block_facts(seps: tuple[str, ...]):
    codes = tuple(s.encode() for s in seps)
    names = [f.split()[0] for f in _FACTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.bool_(), pa.bool_(), pa.int64(),
             *[pa.list_(pa.int64())] * 2]

    def facts(batches):
        key, cases, sniffers, bad, rows = None, [], [], False, 0

        def out():
            found = [(i, c.row()) for i, pair in enumerate([*cases, sniffers]) for c in pair]
            values = [(*key, i, *r[:6], bad, *r[6:]) for i, r in found]
            return pa.RecordBatch.from_arrays([pa.array([v[n] for v in values], k) for n, k in enumerate(kinds)], names)

        for b in batches:
            file, block = (b.column(n).to_numpy(zero_copy_only=False) for n in ("file", "block"))
            for i, j in _segments(file, block):
                if key != (file[i], block[i]):
                    if key is not None:
                        yield out()
                    key, bad, rows = (int(file[i]), int(block[i])), False, 0
                    cases = [(_Case(c, OUT), _Case(c, IN)) for c in codes]
                    sniffers = [_Sniffer(codes, OUT), _Sniffer(codes, IN)]
                lines = _plain(b.column("line").slice(i, j - i))
                if block[i] == 0 and rows == 0 and lines[0].as_py().startswith(_MARK):
                    lines = pa.concat_arrays([pa.array([lines[0].as_py()[len(_MARK):]], lines.type), lines.slice(1)])
                rows += j - i
                bad = bad or not pc.all(b.column("ok").slice(i, j - i)).as_py()
                filled = pc.binary_length(lines).to_numpy(zero_copy_only=False) > 0
                quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
                counts = np.stack([pc.count_substring(lines, s).to_numpy(zero_copy_only=False) for s in seps], axis=1)
                at = 0
                for q in [*quoted.tolist(), j - i]:
                    run = counts[at:q][filled[at:q]]  # empty lines outside quotes are no records
                    if len(run):
                        for k, pair in enumerate(cases):
                            for case in pair:
                                case.lines(run[:, k])
                        for sniffer in sniffers:
                            sniffer.lines(run)
                    if q < j - i:
                        pieces = lines[q].as_py().split(b'"')
                        for case in [c for pair in cases for c in pair] + sniffers:
                            case.quoted(pieces)
                    at = q + 1
        if key is not None:
            yield out()

    return facts


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """``(file, block, line, ok)`` in file order within each block: a line's bytes up to the next line feed."""
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.col("value").cast("binary").alias("line"), F.is_valid_utf8("value").alias("ok"))


def block_facts(spark: SparkSession, paths, seps: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """Pass one: facts of every block for every candidate separator and both first states."""
    from ..session import ship_package
    ship_package(spark)
    return read_lines(spark, paths).mapInArrow(_block_facts(seps), _FACTS)


def block_states(facts: DataFrame) -> DataFrame:
    """The facts of each block from its true first state, with ``entry`` (that state), ``carry`` (separators of the open
    record before the block) and ``open_block`` (where the record that is open there begins).

    A block maps the first state to the last one. Functions that forget the first state set it anew, the
    others keep or swap it, so a running count of swaps since the last setting composes them all.
    """
    pair = facts.groupBy("file", "block", "cand").agg(
        F.max(F.when(F.col("start") == OUT, F.col("last"))).alias("from_out"), F.max(F.when(F.col("start") == IN, F.col("last"))).alias("from_in"))
    before = Window.partitionBy("file", "cand").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "cand").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    swap = (F.col("from_out") == IN) & (F.col("from_in") == OUT)
    constant = F.col("from_out") == F.col("from_in")
    pair = pair.withColumn("_swaps", F.sum(swap.cast("long")).over(upto))
    pair = pair.withColumn("_set", F.last(F.when(constant, F.struct(F.col("from_out").alias("to"), F.col("_swaps").alias("at"))), True).over(before))
    swapped = F.coalesce(F.sum(swap.cast("long")).over(before), F.lit(0)) - F.coalesce("_set.at", F.lit(0))
    entry = pair.select("file", "block", "cand", ((F.coalesce("_set.to", F.lit(OUT)) + swapped) % 2).cast("int").alias("entry"))
    true = facts.join(entry, ["file", "block", "cand"]).where(F.col("start") == F.col("entry")).drop("start")
    # separators since the last record's end: a running sum, less its value at the last block in which a record ended
    ended = F.col("head") >= 0
    true = true.withColumn("_sum", F.sum("tail").over(upto))
    true = true.withColumn("_end", F.last(F.when(ended, F.col("_sum") - F.col("tail")), True).over(before))
    began = F.last(F.when(ended | (F.col("entry") == OUT), F.col("block")), True).over(before)
    return true.select("*", (F.coalesce(F.sum("tail").over(before), F.lit(0)) - F.coalesce("_end", F.lit(0))).alias("carry"),
                       F.coalesce(began, F.col("block")).alias("open_block")).drop("_sum", "_end")


def file_facts(states: DataFrame, n_seps: int) -> DataFrame:
    """``(file, cand, bad, multi, closed, width)`` of every file and candidate separator.

    ``width`` is the cells of the widest record; a cell left open at the file's end counts as its lines do.
    """
    widest = F.greatest(F.col("best"), F.when(F.col("head") >= 0, F.col("carry") + F.col("head")), F.lit(0))
    last_seps = F.col("tail") + F.when(F.col("head") >= 0, 0).otherwise(F.col("carry"))
    return states.where(F.col("cand") < n_seps).groupBy("file", "cand").agg(
        F.max("bad").alias("bad"), F.max("multi").alias("multi"), (F.max_by("last", "block") == OUT).alias("closed"),
        (F.greatest(F.max(widest), F.max_by(last_seps, "block")) + 1).cast("int").alias("width"))


def best_separators(states: DataFrame, n_seps: int) -> DataFrame:
    """``(file, cand)``: the candidate outside quotes on the largest share of a file's lines, then the most frequent one
    (a one-cell title line does not decide it); the first candidate where there is none at all."""
    sums = states.where(F.col("cand") == n_seps).groupBy("file").agg(
        *[F.sum(F.col("hits")[k]).alias(f"h{k}") for k in range(n_seps)],
        *[F.sum(F.col("seps")[k]).alias(f"s{k}") for k in range(n_seps)])
    best = F.array_max(F.array(*[F.struct(F.col(f"h{k}").alias("hits"), F.col(f"s{k}").alias("seps"), F.lit(k).alias("cand"))
                                 for k in range(n_seps)]))
    return sums.select("file", F.when(best["hits"] > 0, best["cand"]).otherwise(0).alias("cand"))


_PIECES = "file bigint, block bigint, row bigint, open_block bigint, whole boolean, record binary"


def _assembled(sep: str):
    code = (sep.encode(),)

    def put_together(batches):
        key, state, row, parts, head = None, OUT, 0, [], False
        names = [f.split()[0] for f in _PIECES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        held: list[tuple] = []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], k) for n, k in enumerate(kinds)], names)
            held.clear()
            return out

        def left_open():
            if parts:
                # the block ends inside a record: a piece of the record that began here, or before
                held.append((key[0], key[1], row, open_block if head else key[1], False, b"\n".join(parts)))

        open_block = 0
        for b in batches:
            file, block, entry, opened = (b.column(n).to_numpy(zero_copy_only=False) for n in ("file", "block", "entry", "open_block"))
            lines = b.column("line")
            for i, j in _segments(file, block):
                if key != (file[i], block[i]):
                    left_open()
                    key, state, row, parts = (int(file[i]), int(block[i])), int(entry[i]), 0, []
                    head, open_block = state == IN, int(opened[i])
                    first = block[i] == 0
                else:
                    first = False
                for line in lines.slice(i, j - i).to_pylist():
                    if first:
                        line, first = line.removeprefix(_MARK), False
                    bare = line[:-1] if line.endswith(b"\r") else line
                    if state == OUT and not parts and not bare:
                        continue
                    state, _ = line_end(bare.split(b'"'), code, state)
                    parts.append(line if state == IN else bare)
                    if state == OUT:
                        held.append((key[0], key[1], row, open_block if head else key[1], not head, b"\n".join(parts)))
                        parts, head = [], False
                        row += 1
                if len(held) >= 5000:
                    yield flush()
        left_open()
        yield flush()

    return put_together


def records(spark: SparkSession, paths, sep: str, states: DataFrame) -> DataFrame:
    """Pass two: ``(file, block, row, record)``, a record's bytes with its line ends; ``states`` has
    (file, block, entry, open_block) of every block for this separator."""
    # one row per block of 128 MB (by default); a shuffled join would lose the order of the lines
    lines = read_lines(spark, paths).drop("ok").join(F.broadcast(states.select("file", "block", "entry", "open_block")), ["file", "block"])
    pieces = lines.select("file", "block", "line", "entry", "open_block").mapInArrow(_assembled(sep), _PIECES)
    whole = pieces.where("whole").select("file", "block", "row", "record")
    # pieces of one record: that of its first block is the last of that block, then one of each block up to its end
    crossing = pieces.where("NOT whole").groupBy("file", "open_block").agg(
        F.sort_array(F.collect_list(F.struct("block", "row", "record"))).alias("p"))
    text = F.expr("aggregate(slice(p, 2, size(p)), p[0].record, (acc, e) -> concat(acc, X'0A', e.record))")
    crossing = crossing.select("file", F.col("open_block").alias("block"), F.col("p")[0]["row"].alias("row"), text.alias("record"))
    return whole.unionByName(crossing)
