import os

from pyspark.sql import functions as F

from tablescope.operators.clean import (clean_table, detect_header_row, drop_total_rows, normalize_column_names,
                                        promote_header)
from tablescope.sources.delimited import read_delimited, sniff_files


def _write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as fh:
        fh.write(text)


BILLING = """CITY HOSPITAL - INPATIENT BILLING REPORT,,
Period: 2024-01-01 to 2024-12-31,Generated: 2024-12-31,

Date,Bill Number,Amount
""" + "".join(f'2024-01-{d:02d},INV-2024-{1000 + d}," ${112.5 * d:,.2f} "\n' for d in range(1, 29)) + \
    """Subtotal,,"$45,000.00"
Grand Total,," $41,875.00 "
Page 1,,
"""


def test_messy_billing_csv(spark, tmp_dir):
    p = os.path.join(tmp_dir, "billing.csv")
    _write(p, BILLING)
    raw = read_delimited(spark, p)
    hdr = detect_header_row(raw).first()
    assert hdr["header_rn"] == 3  # blank line dropped by the reader: banner, period, header
    out = clean_table(raw)
    assert out.columns == ["Date", "Bill Number", "Amount"]
    assert dict(out.dtypes) == {"Date": "timestamp", "Bill Number": "string", "Amount": "double"}
    rows = out.orderBy("Date").collect()
    assert len(rows) == 28
    assert rows[0]["Amount"] == 112.5 and rows[-1]["Amount"] == 3150.0
    assert str(rows[0]["Date"]) == "2024-01-01 00:00:00"


def test_header_names_collisions():
    names = normalize_column_names(["id", "id", "", "Unnamed: 3", "nan", "id_2", " a ", "a", "a_2"])
    assert names == ["id", "id_2", "Column_3", "Column_4", "Column_5", "id_2_2", "a", "a_2", "a_2_2"]
    assert len(set(names)) == len(names)


def test_separators_and_encodings(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "semi.csv"), "Report title\nname;qty;price\nx;1;2.5\ny;2;3.5\n")
    _write(os.path.join(tmp_dir, "tab.csv"), "name\tqty\tprice\nz\t3\t4.5\n")
    _write(os.path.join(tmp_dir, "pipe.csv"), "﻿name|qty|price\nw|4|5.5\n")
    _write(os.path.join(tmp_dir, "latin.csv"), "name,qty,price\ncafé,5,6.5\n", encoding="latin-1")
    sn = {os.path.basename(r["_file"]): (r["sep"], r["encoding"]) for r in sniff_files(spark, tmp_dir).collect()}
    assert sn == {"semi.csv": (";", "UTF-8"), "tab.csv": ("\t", "UTF-8"), "pipe.csv": ("|", "UTF-8"),
                  "latin.csv": (",", "ISO-8859-1")}
    out = clean_table(read_delimited(spark, tmp_dir))
    got = sorted((r["name"], r["qty"], r["price"]) for r in out.collect())
    assert got == [("café", 5, 6.5), ("w", 4, 5.5), ("x", 1, 2.5), ("y", 2, 3.5), ("z", 3, 4.5)]


def test_drop_total_rows_keeps_lookalikes(spark):
    df = spark.createDataFrame([("Sub Total", "1"), ("Totally", "2"), ("Total", "3"), (None, "Summary")],
                               "a string, b string")
    assert [r["b"] for r in drop_total_rows(df).collect()] == ["1", "2"]


def test_sales_sample_shape(spark, tmp_dir):
    lines = ["Order_ID,Order_Date,Region,Customer_Segment,Product_Category,Sales_Amount,Quantity,Discount_Percent,Profit"]
    for i in range(25):
        lines.append(f"ORD-{1001 + i},2025-{1 + i % 3:02d}-{5 + i % 20:02d},{['North', 'South', 'East'][i % 3]},"
                     f"{['Home Office', 'Consumer'][i % 2]},{['Electronics', 'Furniture'][i % 2]},{1250.5 + i},"
                     f"{1 + i % 5},{(i % 4) * 5}%,{250.1 + i}")
    p = os.path.join(tmp_dir, "sales.csv")
    _write(p, "\n".join(lines) + "\n")
    from tablescope.operators.types import collect_types, column_types
    raw = read_delimited(spark, p)
    body = promote_header(raw)
    types = {t["column_name"]: t["detected_type"] for t in collect_types(column_types(body.drop("_file", "_row_ord")))}
    assert types["Order_ID"] == "Unique IDs" and types["Order_Date"] == "Date"
    assert types["Sales_Amount"] == "Currency" and types["Discount_Percent"] == "Percentage"
    assert types["Quantity"] == "Integer" and types["Region"] == "Category" and types["Profit"] == "Float"
    assert clean_table(raw).count() == 25


def test_files_with_different_layouts(spark, tmp_path):
    from tablescope.operators.clean import clean_table
    from tablescope.sources.delimited import read_delimited
    (tmp_path / "a.csv").write_text("id,name,amount\n1,ann,100\n2,bob,101\n3,cy,102\n")
    (tmp_path / "b.csv").write_text("amount,id,name,note\n0.5,7,dee,x\n1.5,8,eve,y\n2.5,9,fay,z\n")
    got = clean_table(read_delimited(spark, str(tmp_path / "*.csv")))
    assert got.columns == ["id", "name", "amount", "note"]
    assert {r["id"]: (r["name"], r["amount"], r["note"]) for r in got.collect()} == {
        1: ("ann", 100.0, None), 2: ("bob", 101.0, None), 3: ("cy", 102.0, None),
        7: ("dee", 0.5, "x"), 8: ("eve", 1.5, "y"), 9: ("fay", 2.5, "z")}


def test_multiline_wide_and_late_latin1(spark, tmp_path):
    from tablescope.sources.delimited import read_delimited
    (tmp_path / "m.csv").write_text('id,text\n1,"line one\nline, two"\n2,x\n')
    rows = read_delimited(spark, str(tmp_path / "m.csv")).orderBy("_row_ord").collect()
    assert [(r["c0"], r["c1"]) for r in rows] == [("id", "text"), ("1", "line one\nline, two"), ("2", "x")]
    (tmp_path / "w.csv").write_text("a,b\n" + "".join(f"{i},n{i}\n" for i in range(60)) + "60,n60,EXTRA,CELLS\n")
    last = read_delimited(spark, str(tmp_path / "w.csv")).where("c0 = '60'").first()
    assert (last["c1"], last["c2"], last["c3"]) == ("n60", "EXTRA", "CELLS")
    (tmp_path / "l.csv").write_bytes(("a,b\n" + "".join(f"{i},plain\n" for i in range(50)) + "50,café\n").encode("latin-1"))
    assert read_delimited(spark, str(tmp_path / "l.csv")).where("c0 = '50'").first()["c1"] == "café"


def test_rows_of_a_file_stay_where_they_are_read(spark):
    """The header row goes to the rows: they are not shuffled by their file, which may be all of them."""
    from pyspark.sql import functions as F

    from tablescope.operators.clean import promote_header
    rows = spark.range(2000).select(F.lit("one").alias("_file"), F.struct(F.lit(0).cast("bigint").alias("block"), F.col("id").alias("row")).alias("_row_ord"),
                                    F.when(F.col("id") == 0, "name").otherwise(F.concat(F.lit("n"), "id")).alias("c0"),
                                    F.when(F.col("id") == 0, "amount").otherwise(F.col("id").cast("string")).alias("c1"))
    body = promote_header(rows.repartition(4))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = body.groupBy(F.spark_partition_id()).count().collect()
        plan = body._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sum(r["count"] for r in parts) == 1999 and len(parts) == 4
    assert "SortMergeJoin _file" not in plan.replace("[", " ")


def test_cells_are_trimmed_of_any_whitespace(spark):
    from tablescope.functions import clean_text, to_number, to_timestamp_mixed
    blanks = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2007\u200a\u2028\u2029\u202f\u205f\u3000"
    df = spark.createDataFrame([(blanks + t + blanks,) for t in ("a b", "1,200.5", "2024-03-05", "20240305", "", "Mar 5, 2024")], "t string")
    got = [tuple(r) for r in df.select(clean_text("t"), to_number("t"), to_timestamp_mixed("t").cast("date").cast("string")).collect()]
    assert got == [("a b", None, None), ("1,200.5", 1200.5, None), ("2024-03-05", None, "2024-03-05"),
                   ("20240305", 20240305.0, "2024-03-05"), (None, None, None), ("Mar 5, 2024", None, "2024-03-05")]
