"""The record scanner against a character-by-character reading, with many small blocks."""
import random

import pytest
from pyspark.sql import functions as F

from tablescope.operators.clean import clean_table
from tablescope.sources.delimited import read_delimited, sniff_files
from tablescope.sources.records import IN, OUT, line_end


def plain_records(text, sep):
    """Cells of every record; a quote opens a cell only as its first character."""
    rows, row, cell, mode, i = [], [], [], "start", 0
    while i < len(text):
        c = text[i]
        if mode == "quoted":
            if c == '"':
                if text[i + 1:i + 2] == '"':
                    cell.append('"')
                    i += 1
                else:
                    mode = "closed"
            else:
                cell.append(c)
        elif c == "\n":
            row.append("".join(cell))
            if row != [""]:
                rows.append(row)
            row, cell, mode = [], [], "start"
        elif c == sep:
            row.append("".join(cell))
            cell, mode = [], "start"
        elif c == '"' and mode == "start":
            mode = "quoted"
        else:
            cell.append(c)
            mode = "plain" if mode != "closed" else mode
        i += 1
    if cell or row:
        rows.append(row + ["".join(cell)])
    return rows


def messy(rng, n, sep):
    def cell():
        kind = rng.random()
        if kind < 0.5:
            return "".join(rng.choice("abc xyz") for _ in range(rng.randint(0, 9)))
        if kind < 0.6:
            return rng.choice(['6" pipe', 'a"b', 'x "y" z', '3"'])
        inner = "".join(rng.choice(["a", "b ", sep, "\n", "\n\n", '""', "é", ";", ",", "|"]) for _ in range(rng.randint(0, 12)))
        return f'"{inner}"'
    return "\n".join(sep.join(["k"] + [cell() for _ in range(rng.randint(1, 5))]) for _ in range(n)) + "\n"


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cells_of(df):
    names = [c for c in df.columns if not c.startswith("_")]
    return [[r[c] or "" for c in names] for r in df.orderBy("_file", "_row_ord").collect()]


def padded(rows):
    width = max(map(len, rows))
    return [r + [""] * (width - len(r)) for r in rows]


@pytest.mark.parametrize("sep,seed", [(",", 1), (";", 2), ("\t", 3)])
def test_random_files_over_many_blocks(spark, tmp_path, small_splits, sep, seed):
    text = messy(random.Random(seed), 150, sep)
    (tmp_path / "a.csv").write_text(text, newline="")
    want = plain_records(text, sep)
    raw = read_delimited(spark, str(tmp_path / "a.csv"), sep=sep, na_tokens=[])
    assert raw.rdd.getNumPartitions() > 4
    got = cells_of(raw)
    assert got == padded(want)


def test_a_cell_over_several_blocks(spark, tmp_path, small_splits):
    long = "line, with ; marks\n" * 200
    text = f'1,"{long}",x\n2,"short\nlines",y\n3,plain,z\n' * 3 + f'4,"{long}"\n'
    (tmp_path / "a.csv").write_text(text, newline="")
    raw = read_delimited(spark, str(tmp_path / "a.csv"), na_tokens=[])
    assert cells_of(raw) == padded(plain_records(text, ","))
    assert sniff_files(spark, str(tmp_path / "a.csv")).first()["multi"]


def test_windows_line_ends_and_mark(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes('﻿"a, b",c\r\n"one\r\ntwo",2\r\n\r\nx,"y"\r\n'.encode())
    got = cells_of(read_delimited(spark, str(tmp_path / "w.csv"), na_tokens=[]))
    assert got == [["a, b", "c"], ["one\r\ntwo", "2"], ["x", "y"]]


def test_inch_marks_and_open_quote(spark, tmp_path):
    rows = "".join(f"{i},b,c,d\n" for i in range(40))
    (tmp_path / "inch.csv").write_text(rows + '41,5" x,6" y,b,EXTRA\n')
    last = cells_of(read_delimited(spark, str(tmp_path / "inch.csv")))[-1]
    assert last == ["41", '5" x', '6" y', "b", "EXTRA"]
    (tmp_path / "open.csv").write_text(rows + '40,"never closed,c,d\n' + rows)
    got = read_delimited(spark, str(tmp_path / "open.csv"))
    assert got.count() == 81 and not sniff_files(spark, str(tmp_path / "open.csv")).first()["multi"]


def test_separator_is_counted_outside_quotes(spark, tmp_path):
    lines = "".join(f'{i};"a, b, c, d, e, f, {i}";x\n' for i in range(60))
    (tmp_path / "s.csv").write_text("title\n" * 35 + lines)
    r = sniff_files(spark, str(tmp_path / "s.csv")).first()
    assert (r["sep"], r["width"], r["multi"]) == (";", 3, False)


def test_files_of_several_kinds_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n')
    (tmp_path / "b.csv").write_bytes("id;note\n2;café\n".encode("latin-1"))
    (tmp_path / "c.csv").write_text("id,note\n3,plain\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text('id|note\n4|"ü\nö"\n', encoding="latin-1")
    got = {r["id"]: r["note"] for r in clean_table(read_delimited(spark, str(tmp_path))).collect()}
    assert got == {1: "two\nlines", 2: "café", 3: "plain", 4: "ü\nö"}
    only = tmp_path / "empty"
    only.mkdir()
    (only / "x.csv").write_text("")
    assert read_delimited(spark, str(only)).count() == 0


def test_line_end_by_state():
    def end(line, state):
        after, (seps,) = line_end(line.encode().split(b'"'), (b",",), state)
        return after, seps
    assert end("a,b", OUT) == (OUT, 1) and end("a,b", IN) == (IN, 0)
    assert end('a,"b', OUT) == (IN, 1) and end('a",b', IN) == (OUT, 1)
    assert end('"a""b,c",d', OUT) == (OUT, 1) and end('""', OUT) == (OUT, 0) and end('"""', OUT) == (IN, 0)
    assert end('5" x,6" y', OUT) == (OUT, 1) and end('"a"b"c,"d', OUT) == (IN, 1) and end("", IN) == (IN, 0)


def test_records_keep_order_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"x\ny"\n2,z\n')
    raw = read_delimited(spark, str(tmp_path / "a.csv"))
    assert raw.columns == ["_file", "_row_ord", "c0", "c1"]
    assert raw.select(F.col("_row_ord.row")).distinct().count() == 2
