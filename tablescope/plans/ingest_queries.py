"""Registered queries C1-C11, S1-S4, S9, S11 with DuckDB twins.

The driver's tables are typed, so the messy inputs are derived from
``orders``: written out as text by Spark into the session's shared scratch
folder, then read back and cleaned.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean_text, to_number, to_timestamp_mixed
from ..operators.clean import clean_table, drop_empty, drop_total_rows
from ..session import scratch_path
from ..sources.delimited import read_delimited
from ..sources.sinks import to_records, write_csv
from .tables import load

SPARK, SQL = {}, {}
ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def register(name, sql=None):
    def deco(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _csv_field(c):
    """Quote a text field for CSV when needed (quotes doubled)."""
    s = c.cast("string")
    need = s.rlike('[",\\n]')
    return F.when(need, F.concat(F.lit('"'), F.regexp_replace(s, '"', '""'), F.lit('"'))).otherwise(s)


@register("csv_round_trip", f"SELECT {ORDERS} FROM orders")
def q_csv_round_trip(spark, sf):
    """S9 → S1 → C11: orders written as CSV, read back as text, cleaned and typed."""
    path = scratch_path(spark, "orders-csv")
    write_csv(load(spark, sf, "orders"), path)
    return clean_table(read_delimited(spark, f"{path}/*.csv"))


REPORT_BUCKETS = 8


@register("messy_report", f"SELECT {ORDERS} FROM orders")
def q_messy_report(spark, sf):
    """Report-style files (banner, header, currency text, M/d/yyyy dates, subtotal,
    grand-total and page rows), one file per (order status, key bucket), cleaned back.

    Each status is split into hash buckets of the order key, so a status
    holding a third of the rows is written by several tasks, not one.
    """
    o = load(spark, sf, "orders").withColumn("_b", F.pmod(F.xxhash64("o_orderkey"), F.lit(REPORT_BUCKETS)))
    keys = ["o_orderstatus", "_b"]
    data = o.select(*keys, F.lit(1).alias("_k"), F.col("o_orderkey").alias("_o"), F.concat_ws(",",
        F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"),
        _csv_field(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))),
        F.date_format("o_orderdate", "M/d/yyyy"), F.col("o_orderpriority")).alias("line"))
    groups = o.groupBy(*keys).agg(F.sum("o_totalprice").alias("_t"))
    banner = groups.select(*keys, F.lit(0).alias("_k"), F.lit(0).cast("bigint").alias("_o"),
                           F.concat(F.lit("ORDERS REPORT - STATUS "), F.col("o_orderstatus")).alias("line"))
    header = groups.select(*keys, F.lit(0).alias("_k"), F.lit(1).cast("bigint").alias("_o"),
                           F.lit("o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority").alias("line"))
    sub = groups.select(*keys, F.lit(2).alias("_k"), F.lit(0).cast("bigint").alias("_o"),
                        F.concat(F.lit("Subtotal,,,"), _csv_field(F.concat(F.lit("$"), F.format_number("_t", 2))),
                                 F.lit(",,")).alias("line"))
    grand = groups.select(*keys, F.lit(2).alias("_k"), F.lit(1).cast("bigint").alias("_o"),
                          F.concat(F.lit("Grand Total,,,"), _csv_field(F.concat(F.lit("$"), F.format_number("_t", 2))),
                                   F.lit(",,")).alias("line"))
    page = groups.select(*keys, F.lit(2).alias("_k"), F.lit(2).cast("bigint").alias("_o"),
                         F.lit("Page 1 of 1").alias("line"))
    lines = data.unionByName(banner).unionByName(header).unionByName(sub).unionByName(grand).unionByName(page)
    path = scratch_path(spark, "orders-report")
    (lines.repartition(*keys).sortWithinPartitions(*keys, "_k", "_o")
     .select(*keys, "line").write.mode("overwrite").partitionBy(*keys).text(path))
    return clean_table(read_delimited(spark, f"{path}/*/*/*.txt"))


@register("drop_total_rows", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
  CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM orders""")
def q_drop_total_rows(spark, sf):
    o = load(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus",
                    F.col("o_totalprice").cast("string").alias("o_totalprice"))
    totals = o.groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("t")).select(
        F.lit(None).cast("string").alias("o_orderkey"),
        F.concat(F.lit("  Total "), F.col("o_orderstatus")).alias("o_orderstatus"),
        F.col("t").cast("string").alias("o_totalprice"))
    notes = o.groupBy("o_orderstatus").count().select(
        F.lit("Notes: generated").alias("o_orderkey"), F.lit(None).cast("string").alias("o_orderstatus"),
        F.lit(None).cast("string").alias("o_totalprice"))
    return drop_total_rows(rows.unionByName(totals).unionByName(notes))


@register("drop_empty", "SELECT o_orderkey, o_orderstatus FROM orders")
def q_drop_empty(spark, sf):
    o = load(spark, sf, "orders")
    rows = o.select("o_orderkey", F.lit(None).cast("string").alias("blank"), "o_orderstatus")
    empty = o.groupBy("o_orderpriority").count().select(F.lit(None).cast("bigint").alias("o_orderkey"),
                                                        F.lit(None).cast("string").alias("blank"),
                                                        F.lit(None).cast("string").alias("o_orderstatus"))
    return drop_empty(rows.unionByName(empty))


@register("coerce_number", "SELECT o_orderkey, o_totalprice AS amount, o_custkey::DOUBLE AS share FROM orders")
def q_coerce_number(spark, sf):
    o = load(spark, sf, "orders")
    txt = o.select("o_orderkey",
                   F.concat(F.lit(" £ "), F.format_number("o_totalprice", 2), F.lit(" ")).alias("amount"),
                   F.concat(F.col("o_custkey").cast("string"), F.lit("%")).alias("share"))
    return txt.select("o_orderkey", to_number("amount").alias("amount"), to_number("share").alias("share"))


@register("coerce_number_junk", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN -1234.5 END AS v FROM orders""")
def q_coerce_number_junk(spark, sf):
    o = load(spark, sf, "orders")
    junk = F.element_at(F.array(F.lit("5d"), F.lit("5f"), F.lit("nan"), F.lit("inf"), F.lit("#N/A"), F.lit(""),
                                F.lit("1-2"), F.lit("abc"), F.lit("-1,234.5")), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return o.select("o_orderkey", to_number(junk).alias("v"))


@register("coerce_date", "SELECT o_orderkey, o_orderdate FROM orders")
def q_coerce_date(spark, sf):
    o = load(spark, sf, "orders")
    fmt = (F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "M/d/yyyy"))
           .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
           .otherwise(F.date_format("o_orderdate", "d MMM yyyy")))
    return o.select("o_orderkey", to_timestamp_mixed(fmt).alias("o_orderdate"))


@register("coerce_text", """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS p FROM orders""")
def q_coerce_text(spark, sf):
    o = load(spark, sf, "orders")
    raw = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(" #N/A ")).otherwise(
        F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("\t")))
    return o.select("o_orderkey", clean_text(raw).alias("p"))


@register("to_records", """SELECT '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus
  || '","o_totalprice":' || CAST(o_totalprice AS VARCHAR) || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
  || '","o_orderpriority":"' || o_orderpriority || '"}' AS record FROM orders""")
def q_to_records(spark, sf):
    return to_records(load(spark, sf, "orders"))


@register("messy_layouts", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def q_messy_layouts(spark, sf):
    """Files whose headers name the columns in different orders, read in one call."""
    path = scratch_path(spark, "layouts")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    odd = F.col("o_orderkey") % 2 == 1
    orders.where(~odd).write.option("header", True).csv(f"{path}/a")
    orders.where(odd).select("o_totalprice", "o_orderpriority", "o_orderkey", "o_orderstatus").write.option("header", True).csv(f"{path}/b")
    return clean_table(read_delimited(spark, f"{path}/*/*.csv"))


@register("analyze_page", f"""SELECT {ORDERS}, position FROM (
  SELECT *, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS position FROM orders) WHERE position BETWEEN 51 AND 100""")
def q_analyze_page(spark, sf):
    """C11 → L2: a page of a cleaned file without a sort comes in file order (here by customer, descending)."""
    from .analyze import analyze
    path = scratch_path(spark, "ordered-csv")
    order = [F.desc("o_custkey"), F.col("o_orderkey")]
    write_csv(load(spark, sf, "orders").repartitionByRange(*order).sortWithinPartitions(*order), path)  # the files' names keep the order
    table = clean_table(read_delimited(spark, f"{path}/*.csv"), keep_order=True)
    return analyze(table, {"page": 2, "page_size": 50})["rows"]


@register("csv_inch_marks", """SELECT o_orderkey::VARCHAR AS c0, CASE WHEN o_orderkey % 97 = 5 THEN '5" x' ELSE o_orderstatus END AS c1,
  CASE WHEN o_orderkey % 97 = 5 THEN '6" y' ELSE 'a, "quoted" b' END AS c2, o_orderpriority AS c3,
  CASE WHEN o_orderkey % 97 = 5 THEN 'EXTRA' END AS c4 FROM orders""")
def q_csv_inch_marks(spark, sf):
    """Quotes inside cells are characters; separators between them count, and the widest record keeps its last cell."""
    path = scratch_path(spark, "inch-csv")
    wide = F.col("o_orderkey") % 97 == 5
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.when(wide, F.lit('5" x,6" y')).otherwise(
        F.concat(F.col("o_orderstatus"), F.lit(',"a, ""quoted"" b"'))), "o_orderpriority", F.when(wide, F.lit("EXTRA")))
    load(spark, sf, "orders").select(line.alias("value"), wide.alias("w")).sortWithinPartitions("w").select("value").write.text(path)
    return read_delimited(spark, f"{path}/*.txt").select("c0", "c1", "c2", "c3", "c4")


NA_CELLS = ["#N/A", "#REF!", "#VALUE!", "#DIV/0!", "#NAME?", "#NULL!", "#NUM!", "#ERROR!", "", "NA", "N/A", "NULL", "None"]


@register("csv_na_tokens", f"""SELECT o_orderkey::VARCHAR AS c0, CASE WHEN o_orderkey % 15 >= {len(NA_CELLS)} THEN o_orderpriority END AS c1,
  CASE o_orderkey % 15 WHEN 0 THEN 'na' WHEN 1 THEN 'N/A ' WHEN 2 THEN 'nan' ELSE o_orderstatus END AS c2 FROM orders""")
def q_csv_na_tokens(spark, sf):
    """Every missing-value token as a cell is NULL; near misses stay text."""
    path = scratch_path(spark, "na-csv")
    k = F.col("o_orderkey") % 15
    token = F.try_element_at(F.array(*[F.lit(t) for t in NA_CELLS]), (k + 1).cast("int"))
    near = F.when(k == 0, "na").when(k == 1, "N/A ").when(k == 2, "nan").otherwise(F.col("o_orderstatus"))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.coalesce(token, F.col("o_orderpriority")), near)
    load(spark, sf, "orders").select(line.alias("value")).write.text(path)
    return read_delimited(spark, f"{path}/*.txt").select("c0", "c1", "c2")


@register("header_names_clash", """SELECT o_orderkey AS id, o_custkey AS id_2, o_orderkey % 7 AS "Column_3", o_orderkey % 5 AS "Column_4",
  o_orderkey % 3 AS "Column_5", o_orderpriority AS id_2_2 FROM orders""")
def q_header_names_clash(spark, sf):
    """Repeated, blank, ``Unnamed`` and ``nan`` header cells, and one that a made-up name would repeat."""
    path = scratch_path(spark, "clash-csv")
    k = F.col("o_orderkey")
    rows = load(spark, sf, "orders").select(F.concat_ws(",", *[c.cast("string") for c in (k, F.col("o_custkey"), k % 7, k % 5, k % 3)],
                                                        "o_orderpriority").alias("value"))
    bucket = F.pmod(F.xxhash64("value"), F.lit(REPORT_BUCKETS)).alias("b")
    heads = spark.range(REPORT_BUCKETS).select(F.lit("id,id,,Unnamed: 3,nan,id_2").alias("value"), F.col("id").alias("b"), F.lit(0).alias("k"))
    (heads.unionByName(rows.select("value", bucket, F.lit(1).alias("k"))).repartition("b").sortWithinPartitions("b", "k")
     .select("b", "value").write.partitionBy("b").text(f"{path}/files"))
    return clean_table(read_delimited(spark, f"{path}/files/*/*.txt"))


@register("coercion_empty_rows", "SELECT o_totalprice AS amount, o_orderdate AS day, o_orderpriority AS priority FROM orders WHERE o_orderkey % 50 <> 3")
def q_coercion_empty_rows(spark, sf):
    """Rows whose cells are filled as text but empty as numbers, dates and text go after the coercion."""
    k = F.col("o_orderkey")
    junk = k % 50 == 3
    raw = load(spark, sf, "orders").select(
        F.lit("all").alias("_file"), F.struct(F.lit(0).cast("bigint").alias("block"), k.alias("row")).alias("_row_ord"),
        F.when(junk, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("c0"),
        F.when(junk, F.lit("not a date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("c1"),
        F.when(junk, F.lit("  #REF! ")).otherwise(F.col("o_orderpriority")).alias("c2"))
    head = spark.range(1).select(F.lit("all").alias("_file"), F.struct(F.lit(0).cast("bigint").alias("block"), F.lit(-1).cast("bigint").alias("row"))
                                 .alias("_row_ord"), F.lit("amount").alias("c0"), F.lit("day").alias("c1"), F.lit("priority").alias("c2"))
    return clean_table(head.unionByName(raw))


@register("csv_wide_row", """SELECT o_orderkey::VARCHAR AS c0, o_orderstatus AS c1,
  CASE WHEN o_orderkey % 97 = 5 THEN 'extra' END AS c2, CASE WHEN o_orderkey % 97 = 5 THEN 'a, quoted' END AS c3 FROM orders""")
def q_csv_wide_row(spark, sf):
    """Lines with more cells than the first ones keep them."""
    path = scratch_path(spark, "wide-csv")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus",
                       F.when(F.col("o_orderkey") % 97 == 5, F.lit('extra,"a, quoted"')))
    wide = F.col("o_orderkey") % 97 == 5
    load(spark, sf, "orders").select(line.alias("value"), wide.alias("w"), "o_orderkey").sortWithinPartitions(
        "w", "o_orderkey").select("value").write.text(path)
    return read_delimited(spark, f"{path}/*.txt").select("c0", "c1", "c2", "c3")


@register("csv_late_latin1", """SELECT doc_id::VARCHAR AS c0, replace(replace(text, chr(10), ' '), '"', '') AS c1 FROM documents""")
def q_csv_late_latin1(spark, sf):
    """Latin-1 files whose first non-ASCII byte stands behind all English texts."""
    path = scratch_path(spark, "latin1-csv")
    docs = load(spark, sf, "documents").select(
        "doc_id", F.regexp_replace(F.replace("text", F.lit("\n"), F.lit(" ")), '"', "").alias("t"), (F.col("lang") != "en").alias("late"))
    (docs.sortWithinPartitions("late", "doc_id").drop("late").write.option("encoding", "ISO-8859-1")
     .option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_delimited(spark, f"{path}/*.csv").select("c0", "c1")


@register("csv_multiline", "SELECT doc_id::VARCHAR AS c0, text AS c1, lang AS c2, source AS c3, n_chars::VARCHAR AS c4 FROM documents")
def q_csv_multiline(spark, sf):
    """Quoted cells with line ends are one cell."""
    path = scratch_path(spark, "multiline-csv")
    (load(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars").write.option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_delimited(spark, f"{path}/*.csv").select("c0", "c1", "c2", "c3", "c4")


@register("to_records_events", """SELECT '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') END
  || '","user_id":' || user_id || ',"event_type":"' || event_type || '","value":' || CAST(value AS VARCHAR) || ',"props":' || to_json(props) || '}' AS record FROM events""")
def q_to_records_events(spark, sf):
    """S11 with fractions of a second."""
    return to_records(load(spark, sf, "events"))


@register("csv_round_trip_events", "SELECT * FROM events")
def q_csv_round_trip_events(spark, sf):
    """Fractions of a second survive the file."""
    path = scratch_path(spark, "events-csv")
    events = load(spark, sf, "events")
    write_csv(events, path)
    schema = ", ".join(f"{c} {'string' if c == 'ts' else t}" for c, t in events.dtypes)
    raw = spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@register("csv_semicolon_latin1", f"SELECT {ORDERS} FROM orders")
def q_csv_semicolon_latin1(spark, sf):
    """Orders written ';'-separated in latin-1; separator and encoding are sniffed."""
    path = scratch_path(spark, "orders-latin1")
    (load(spark, sf, "orders").write.mode("overwrite").option("header", True).option("sep", ";")
     .option("encoding", "ISO-8859-1").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    return clean_table(read_delimited(spark, f"{path}/*.csv"))
