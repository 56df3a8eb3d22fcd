"""DuckDB twins of the profile/type queries (independent SQL, same column_name names)."""
from __future__ import annotations

from ..functions.constants import (BOOLEAN_TOKENS, CURRENCY_NAME_KEYWORDS, EXCEL_ERRORS, ID_KEYWORDS)

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
ORDERS_KINDS = {"o_orderkey": "integral", "o_custkey": "integral", "o_orderstatus": "string",
                "o_totalprice": "fractional", "o_orderdate": "timestamp", "o_orderpriority": "string"}
LINEITEM_KINDS = {"l_orderkey": "integral", "l_partkey": "integral", "l_suppkey": "integral",
                  "l_linenumber": "integral", "l_quantity": "fractional", "l_extendedprice": "fractional",
                  "l_discount": "fractional", "l_tax": "fractional", "l_returnflag": "string",
                  "l_linestatus": "string", "l_shipdate": "timestamp"}

# RE2 spellings of the type patterns (ASCII data)
SQL_EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
SQL_PHONE = r"^\+?[\d\s\-\(\)]{7,20}$"
SQL_URL = r"(?i)^https?://[^\s/$.?#].[^\s]*$"
SQL_IMAGE = r"(?i)^https?://[^\s]+\.(jpg|jpeg|png|gif|webp|svg)(\?.*)?$"
SQL_FILE = r"(?i)^https?://[^\s]+\.(pdf|doc|docx|zip|rar|csv|xlsx|xls)(\?.*)?$"
SQL_DATE_FORMATS = [
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z",
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M", "%Y-%m-%d",
    "%Y/%m/%d", "%Y/%m/%d %H:%M:%S", "%Y%m%d",
    "%m/%d/%Y", "%m/%d/%Y %H:%M", "%m/%d/%Y %H:%M:%S", "%d/%m/%Y",
    "%m-%d-%Y", "%d-%m-%Y", "%m.%d.%Y", "%d.%m.%Y",
    "%b %d, %Y", "%d %b %Y", "%B %d, %Y", "%Y-%m",
]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def to_number_sql(x: str) -> str:
    t = f"trim(CAST({x} AS VARCHAR))"
    bare = f"regexp_replace({t}, '[$,£€¥₹%\\s]', '', 'g')"
    return (f"CASE WHEN {t} IS NOT NULL AND {t} NOT IN {sql_list(EXCEL_ERRORS)} "
            f"AND regexp_full_match({bare}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN TRY_CAST({bare} AS DOUBLE) END")


def to_ts_sql(x: str) -> str:
    t = f"trim({x})"
    fmts = "[" + ", ".join(q(f) for f in SQL_DATE_FORMATS) + "]"
    return (f"CASE WHEN {t} <> '' AND {t} NOT IN {sql_list(EXCEL_ERRORS)} "
            f"AND regexp_matches({x}, '[0-9]') THEN CAST(try_strptime({t}, {fmts}) AS TIMESTAMP) END")


def views(table: str, col: str, kind: str) -> tuple[str, str, str]:
    """(value text, number view, timestamp view) of a column; nested values
    ("other") are text that is never parsed as a number or a date."""
    if kind == "other":
        return f"CAST({col} AS VARCHAR)", "NULL::DOUBLE", "NULL::TIMESTAMP"
    if kind in ("integral", "fractional"):
        return f"CAST({col} AS VARCHAR)", f"CAST({col} AS DOUBLE)", "NULL::TIMESTAMP"
    if kind == "timestamp":
        return f"CAST({col} AS VARCHAR)", "NULL::DOUBLE", f"CAST({col} AS TIMESTAMP)"
    return col, to_number_sql(col), to_ts_sql(col)


def signals_sql(table: str, kinds: dict) -> str:
    parts = []
    for pos, (c, kind) in enumerate(kinds.items()):
        v, num, ts = views(table, c, kind)
        time_cond = ("(hour(ts) <> 0 OR minute(ts) <> 0 OR second(ts) <> 0)" if kind == "timestamp"
                     else "(hour(ts) <> 0 OR minute(ts) <> 0)")
        parts.append(f"""SELECT {q(c)} AS column_name, {pos} AS pos, {q(kind)} AS kind,
  count(*) FILTER (WHERE v IS NULL) AS null_count, count(v) AS non_null, count(DISTINCT v) AS unique_count,
  count(num) AS num_ok, count(*) FILTER (WHERE contains(v, '%')) AS pct_n,
  count(*) FILTER (WHERE regexp_matches(v, '[$,£€¥₹]')) AS cur_n,
  coalesce(bool_and(num = floor(num)) FILTER (WHERE num IS NOT NULL), false) AS all_integral,
  count(ts) AS date_ok, coalesce(bool_or({time_cond}) FILTER (WHERE ts IS NOT NULL), false) AS has_time,
  count(*) FILTER (WHERE lower(trim(v)) IN {sql_list(BOOLEAN_TOKENS)}) AS bool_n,
  count(*) FILTER (WHERE regexp_matches(v, {q(SQL_EMAIL)})) AS email_n,
  count(*) FILTER (WHERE regexp_matches(v, {q(SQL_IMAGE)})) AS image_n,
  count(*) FILTER (WHERE regexp_matches(v, {q(SQL_FILE)})) AS file_n,
  count(*) FILTER (WHERE regexp_matches(v, {q(SQL_URL)})) AS url_n,
  count(*) FILTER (WHERE regexp_matches(v, {q(SQL_PHONE)})) AS phone_n
FROM (SELECT {v} AS v, {num} AS num, {ts} AS ts FROM {table})""")
    return "\nUNION ALL\n".join(parts)


def types_sql(table: str, kinds: dict) -> str:
    """Full rule chain in SQL; returns the column_types columns plus pos."""
    idk = sql_list(ID_KEYWORDS)
    cur = "|".join(CURRENCY_NAME_KEYWORDS)
    return f"""WITH s AS ({signals_sql(table, kinds)}),
f AS (SELECT *,
  non_null > 0 AND num_ok / non_null >= 0.8 AS is_num,
  list_has_any(string_split_regex(lower(trim(column_name)), '[\\s_\\-]+'), {idk.replace('(', '[').replace(')', ']')})
    OR ends_with(lower(trim(column_name)), 'id') OR starts_with(lower(trim(column_name)), 'id_') AS name_id,
  regexp_matches(lower(trim(column_name)), {q(cur)}) AS name_cur FROM s),
g AS (SELECT *, NOT is_num AND non_null > 0 AND (kind = 'timestamp' OR date_ok / non_null >= 0.8) AS is_dt FROM f),
h AS (SELECT *, NOT is_num AND NOT is_dt AND non_null > 0 AND bool_n / non_null >= 0.8 AS is_bool FROM g),
k AS (SELECT *, NOT is_num AND NOT is_dt AND NOT is_bool AND non_null > 0 AND name_id AS is_idc FROM h)
SELECT column_name, pos,
  CASE WHEN non_null = 0 THEN 'Text'
       WHEN is_num THEN (CASE WHEN pct_n / non_null > 0.2 THEN 'Percentage'
                              WHEN cur_n / non_null > 0.2 OR name_cur THEN 'Currency'
                              WHEN all_integral THEN 'Integer' ELSE 'Float' END)
       WHEN is_dt THEN (CASE WHEN has_time THEN 'Datetime' ELSE 'Date' END)
       WHEN is_bool THEN 'Boolean'
       WHEN is_idc THEN 'Unique IDs'
       WHEN email_n / non_null > 0.8 THEN 'Email'
       WHEN image_n / non_null > 0.8 THEN 'Image URL'
       WHEN file_n / non_null > 0.8 THEN 'File URL'
       WHEN url_n / non_null > 0.8 THEN 'URL'
       WHEN phone_n / non_null > 0.8 THEN 'Phone Number'
       WHEN unique_count <= 100 THEN 'Category' ELSE 'Text' END AS detected_type,
  is_idc AS is_id, is_num AS is_numeric, is_dt AS is_date,
  (non_null > 0 AND NOT is_num AND NOT is_dt) AS is_categorical,
  unique_count, null_count, non_null
FROM k"""


def types_query(table: str, kinds: dict) -> str:
    return f"""SELECT column_name, detected_type, is_id, is_numeric, is_date, is_categorical,
  (non_null = 0 OR detected_type IN ('Email', 'URL', 'Image URL', 'File URL', 'Phone Number')) AS exclude_from_charts,
  unique_count, null_count FROM ({types_sql(table, kinds)})"""


def summary_sql(table: str, kinds: dict, extra: str = "") -> str:
    cols = list(kinds)
    n = len(cols)
    missing = " + ".join(f"(count(*) - count({c}))" for c in cols)
    return f"""WITH t AS (SELECT * FROM {table}),
m AS (SELECT count(*) AS total_rows, ({missing}) AS missing_values FROM t),
d AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM t GROUP BY {', '.join(cols)}) ),
ty AS ({types_sql(table, kinds)}),
c AS (SELECT
  sum(CASE WHEN is_numeric AND NOT is_id THEN 1 ELSE 0 END)::BIGINT AS numeric_columns_count,
  sum(CASE WHEN is_categorical OR detected_type IN ('Category', 'Boolean', 'Text') THEN 1 ELSE 0 END)::BIGINT AS categorical_columns_count,
  sum(CASE WHEN is_date THEN 1 ELSE 0 END)::BIGINT AS date_columns_count,
  sum(CASE WHEN detected_type = 'Boolean' THEN 1 ELSE 0 END)::BIGINT AS boolean_columns_count FROM ty)
SELECT total_rows, {n}::BIGINT AS total_columns, missing_values::BIGINT AS missing_values,
  round_even(missing_values / greatest(total_rows * {n}, 1) * 100, 2) AS missing_percentage,
  duplicate_rows, numeric_columns_count, categorical_columns_count, date_columns_count, boolean_columns_count
  {extra}
FROM m, d, c"""


def union(cols, tmpl) -> str:
    return "\nUNION ALL\n".join(tmpl.format(c=c, i=i) for i, c in enumerate(cols))


LINEITEM_NULLS_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS l_tax,
  CASE WHEN l_linenumber <= 3 THEN NULL ELSE l_returnflag END AS l_returnflag,
  l_linestatus, l_shipdate FROM lineitem)"""

MOMENTS = """SELECT '{c}' AS column_name, min(x) AS min, max(x) AS max, round_even(avg(x), 4) AS mean,
  CASE WHEN count(x) > 1 THEN round_even(var_samp(x), 4) ELSE 0.0 END AS variance,
  CASE WHEN count(x) > 1 THEN round_even(stddev_samp(x), 4) ELSE 0.0 END AS std_dev,
  CASE WHEN count(x) > 2 THEN round_even(coalesce(CASE WHEN isnan(skewness(x)) THEN NULL ELSE skewness(x) END, 0), 4) ELSE 0.0 END AS skewness,
  CASE WHEN count(x) > 3 THEN round_even(coalesce(CASE WHEN isnan(kurtosis(x)) THEN NULL ELSE kurtosis(x) END, 0), 4) ELSE 0.0 END AS kurtosis
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {t})"""

QUARTS = """SELECT '{c}' AS column_name, round_even(quantile_cont(x, 0.25), 4) AS q1, round_even(quantile_cont(x, 0.5), 4) AS median,
  round_even(quantile_cont(x, 0.75), 4) AS q3, round_even(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) AS iqr
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM lineitem)"""

MODE = """SELECT '{c}' AS column_name, x AS mode FROM (SELECT x, row_number() OVER (ORDER BY n DESC, x ASC) AS r
  FROM (SELECT CAST({c} AS DOUBLE) AS x, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1)) WHERE r = 1"""

OUTLIERS = """SELECT '{c}' AS column_name, count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))::BIGINT AS outliers_count
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM lineitem) v,
     (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM lineitem) b"""


def top_sql(table: str, kinds: dict, asc: bool) -> str:
    f = union(list(kinds), "SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM "
              + table + " WHERE {c} IS NOT NULL GROUP BY 2")
    order = "cnt ASC" if asc else "cnt DESC"
    return f"""WITH f AS ({f}),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY {order}, value ASC) AS rank,
  sum(cnt) OVER (PARTITION BY column_name) AS total FROM f)
SELECT column_name, rank::INTEGER AS rank, value, cnt AS count, round_even(cnt / greatest(total, 1) * 100, 2) AS percentage
FROM r WHERE rank <= 10"""


def hist_sql(table_expr: str, cols: list[str]) -> str:
    v = union(cols, "SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS x FROM " + table_expr + " WHERE {c} IS NOT NULL")
    return f"""WITH v AS ({v}),
b AS (SELECT column_name, count(*) AS n, min(x) AS mn, max(x) AS mx FROM v GROUP BY column_name),
s0 AS (SELECT column_name, n, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS first,
  CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS last,
  CAST(least(10, greatest(3, floor(sqrt(n)))) AS BIGINT) AS bins FROM b),
s AS (SELECT *, (last - first) / bins AS step FROM s0),
g0 AS (SELECT v.column_name, v.x, s.first, s.last, s.step, s.bins,
  CAST(trunc(((v.x - s.first) / (s.last - s.first)) * s.bins) AS BIGINT) AS gi FROM v JOIN s USING (column_name)),
g1 AS (SELECT *, CASE WHEN gi = bins THEN bins - 1 ELSE gi END AS g FROM g0),
g2 AS (SELECT *, CASE WHEN x < (CASE WHEN g = bins THEN last ELSE g * step + first END) THEN g - 1 ELSE g END AS d FROM g1),
g3 AS (SELECT column_name, CASE WHEN x >= (CASE WHEN d + 1 = bins THEN last ELSE (d + 1) * step + first END) AND d <> bins - 1
  THEN d + 1 ELSE d END AS bin FROM g2),
c AS (SELECT column_name, bin, count(*) AS cnt FROM g3 GROUP BY ALL),
sp AS (SELECT column_name, first, last, step, bins, unnest(range(0, bins)) AS bin FROM s)
SELECT sp.column_name, CAST(sp.bin AS INTEGER) AS bin,
  round_even(sp.bin * step + first, 4) AS lo,
  round_even(CASE WHEN sp.bin + 1 = bins THEN last ELSE (sp.bin + 1) * step + first END, 4) AS hi,
  CAST(round_even(sp.bin * step + first, 2) AS VARCHAR) || ' - ' ||
  CAST(round_even(CASE WHEN sp.bin + 1 = bins THEN last ELSE (sp.bin + 1) * step + first END, 2) AS VARCHAR) AS label,
  coalesce(c.cnt, 0)::BIGINT AS count
FROM sp LEFT JOIN c ON sp.column_name = c.column_name AND sp.bin = c.bin"""


def corr_sql(table_expr: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            parts.append(f"""SELECT '{a}' AS col_x, '{b}' AS col_y, {i} AS pos_x, {j} AS pos_y,
  CASE WHEN r IS NULL OR isnan(r) THEN 0.0 ELSE round_even(r, 4) END AS r
FROM (SELECT corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM {table_expr})""")
    return "\nUNION ALL\n".join(parts)


def text_table_sql() -> str:
    return """(SELECT '$' || format('{:,.2f}', o_totalprice) AS amount_text,
  CAST(o_custkey % 100 AS VARCHAR) || '%' AS share,
  strftime(o_orderdate, '%-m/%-d/%Y') AS when_text,
  CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS flag,
  'ORD-' || CAST(o_orderkey AS VARCHAR) AS order_no,
  'user' || CAST(o_custkey % 50 AS VARCHAR) || '@mail.example.com' AS contact,
  o_orderpriority FROM orders)"""


TEXT_KINDS = {c: "string" for c in ["amount_text", "share", "when_text", "flag", "order_no", "contact",
                                     "o_orderpriority"]}

SQL = {
    "dataset_summary": summary_sql("orders", ORDERS_KINDS),
    "dataset_summary_nulls": summary_sql(LINEITEM_NULLS_SQL, LINEITEM_KINDS),
    "duplicate_rows": """SELECT count(*) FILTER (WHERE o_orderkey % 10 = 0) + count(*) FILTER (WHERE o_orderkey % 30 = 0) AS duplicate_rows FROM orders""",
    "estimated_bytes": """SELECT round_even((sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority)) + count(*) * 32) / (1024 * 1024), 3) AS estimated_mb FROM orders""",
    "null_and_distinct": union(list(LINEITEM_KINDS),
                               "SELECT '{c}' AS column_name, (count(*) - count({c}))::BIGINT AS null_count, "
                               "round_even((count(*) - count({c})) / greatest(count(*), 1) * 100, 2) AS null_percentage, "
                               "count(DISTINCT {c}) AS unique_count FROM " + LINEITEM_NULLS_SQL.replace("{", "{{").replace("}", "}}")),
    "numeric_stats": union(LINEITEM_NUM, MOMENTS.replace("{t}", "lineitem")),
    "quantiles": union(LINEITEM_NUM, QUARTS),
    "quantiles_nulls": "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, {p} AS p, round_even(quantile_cont(CAST({c} AS DOUBLE), {p}), 4) AS value FROM "
        + LINEITEM_NULLS_SQL for c in ["l_discount", "l_tax", "l_quantity"] for p in (0.1, 0.25, 0.5, 0.9)),
    "mode": union(LINEITEM_NUM, MODE),
    "outliers": union(LINEITEM_NUM, OUTLIERS),
    "skew_kurt": "SELECT column_name, skewness, kurtosis FROM (" + union(LINEITEM_NUM, MOMENTS.replace("{t}", "lineitem")) + ")",
    "top_values": top_sql("orders", ORDERS_KINDS, asc=False),
    "bottom_values": top_sql("orders", ORDERS_KINDS, asc=True),
    "histogram": hist_sql("lineitem", LINEITEM_NUM),
    "histogram_constant": hist_sql("(SELECT 7.0::DOUBLE AS k, o_totalprice FROM orders)", ["k", "o_totalprice"]),
    "monthly_distribution": """SELECT 'o_orderdate' AS column_name, strftime(o_orderdate, '%Y-%m') AS label, count(*)::BIGINT AS count
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 2""",
    "date_range": """SELECT 'o_orderdate' AS column_name,
  CASE WHEN bool_or(hour(o_orderdate) <> 0 OR minute(o_orderdate) <> 0 OR second(o_orderdate) <> 0)
    THEN strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') ELSE strftime(min(o_orderdate), '%Y-%m-%d') END AS min_date,
  CASE WHEN bool_or(hour(o_orderdate) <> 0 OR minute(o_orderdate) <> 0 OR second(o_orderdate) <> 0)
    THEN strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') ELSE strftime(max(o_orderdate), '%Y-%m-%d') END AS max_date FROM orders
UNION ALL
SELECT 'ts' AS column_name,
  CASE WHEN bool_or(hour(ts) <> 0 OR minute(ts) <> 0 OR second(ts) <> 0)
    THEN strftime(min(ts), '%Y-%m-%d %H:%M:%S') ELSE strftime(min(ts), '%Y-%m-%d') END,
  CASE WHEN bool_or(hour(ts) <> 0 OR minute(ts) <> 0 OR second(ts) <> 0)
    THEN strftime(max(ts), '%Y-%m-%d %H:%M:%S') ELSE strftime(max(ts), '%Y-%m-%d') END FROM events""",
    "correlation": corr_sql("lineitem", LINEITEM_NUM),
    "correlation_with_nulls": corr_sql(LINEITEM_NULLS_SQL, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "correlation_constant": corr_sql("(SELECT 1.5::DOUBLE AS k, o_totalprice, o_custkey FROM orders)",
                                     ["k", "o_totalprice", "o_custkey"]),
    "correlation_outlier_null": corr_sql("""(SELECT CASE WHEN l_linenumber = 1 THEN -1e9 ELSE l_quantity END AS quantity,
  CASE WHEN l_linenumber <> 1 THEN l_extendedprice END AS price, l_extendedprice + 1e9 AS far, 0.1::DOUBLE AS same FROM lineitem)""",
                                         ["quantity", "price", "far", "same"]),
    "column_types": types_query("orders", ORDERS_KINDS),
    "column_types_lineitem": types_query("lineitem", LINEITEM_KINDS),
    "column_types_url": types_query("pages", {"page_id": "integral", "url": "string", "html": "string"}),
    "column_types_text": types_query(text_table_sql(), TEXT_KINDS),
    "column_types_zoo": types_query("""(SELECT repeat(' ', 35) || strftime(o_orderdate, '%Y-%m-%d') AS padded_day,
  'https://img.example.com/' || o_orderkey || '.png' AS picture, 'https://files.example.com/' || o_orderkey || '.pdf' AS paper,
  '+1 555 010 ' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS call, NULL::VARCHAR AS nothing FROM orders)""",
                                   {c: "string" for c in ["padded_day", "picture", "paper", "call", "nothing"]}),
}


def _report_sql():
    cols = list(LINEITEM_KINDS)
    summ = summary_sql("lineitem", LINEITEM_KINDS)
    est = " + ".join(f"coalesce(sum(strlen({c})), 0)" for c, k in LINEITEM_KINDS.items() if k == "string")
    fixed = 8 * 8 + 4  # eight 8-byte columns, one INT column
    metrics = [("Total Rows", "total_rows"), ("Total Columns", "total_columns"), ("Missing Values", "missing_values"),
               ("Missing Values %", "missing_percentage"), ("Duplicate Rows", "duplicate_rows"),
               ("Memory Usage (MB)", "estimated_mb"), ("Numeric Columns", "numeric_columns_count"),
               ("Categorical Columns", "categorical_columns_count"), ("Date Columns", "date_columns_count")]
    sel = "\nUNION ALL\n".join(f"SELECT {i} AS ord, '{m}' AS metric, CAST({c} AS DOUBLE) AS value FROM s"
                               for i, (m, c) in enumerate(metrics)) + "\nUNION ALL SELECT 9, 'Analysis Time (ms)', NULL"
    summary = f"""WITH s0 AS ({summ}),
e AS (SELECT round_even(({est} + count(*) * {fixed}) / (1024 * 1024), 3) AS estimated_mb FROM lineitem),
s AS (SELECT * FROM s0, e)
{sel}"""
    details = f"""WITH t AS ({types_sql("lineitem", LINEITEM_KINDS)}),
n AS ({union(cols, "SELECT '{c}' AS column_name, CAST(round_even((count(*) - count({c})) / greatest(count(*), 1) * 100, 2) AS DOUBLE) AS null_percentage FROM lineitem")}),
m AS ({union(LINEITEM_NUM, MOMENTS.replace("{t}", "lineitem"))}),
q AS ({union(LINEITEM_NUM, QUARTS)}),
md AS ({union(LINEITEM_NUM, MODE)}),
o AS ({union(LINEITEM_NUM, OUTLIERS)})
SELECT t.column_name AS "Column", detected_type AS "Type", null_count AS "Null Count", null_percentage AS "Null %",
  unique_count AS "Unique Values", m.min AS "Min", m.max AS "Max", m.mean AS "Mean", q.median AS "Median",
  md.mode AS "Mode", m.std_dev AS "Std Dev", q.iqr AS "IQR", CAST(o.outliers_count AS DOUBLE) AS "Outliers"
FROM t JOIN n USING (column_name) LEFT JOIN m USING (column_name) LEFT JOIN q USING (column_name)
  LEFT JOIN md USING (column_name) LEFT JOIN o USING (column_name)"""
    corr = corr_sql("lineitem", LINEITEM_NUM)
    pivot_cols = ", ".join(f"max(CASE WHEN col_y = '{c}' THEN r END) AS {c}" for c in LINEITEM_NUM)
    matrix = f"SELECT col_x AS column_name, {pivot_cols} FROM ({corr}) GROUP BY col_x"
    return {"report_summary": summary, "report_columns": details, "report_matrix": matrix}


SQL.update(_report_sql())


SQL["column_types_embeddings"] = types_query("embeddings", {"vec_id": "integral", "embedding": "other", "label": "integral"})
