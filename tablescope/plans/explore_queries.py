"""Registered queries F1-F7, J1-J2, L1-L5, A20-A24, W4, G1-G13, I1-I6 and their DuckDB twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import safe
from ..operators import charts as ch
from ..operators.corr import correlation
from ..operators.filters import FilterSpec, apply_filters, facets, filter_in_values, project_columns
from ..operators.freq import frequency_table
from ..operators.groups import category_counts, group_sums, top_n_with_others
from ..operators.insights import insights
from ..operators.paging import head, latest, page, page_info, sort_orders, with_positions
from ..operators.profile import (column_counts, dataset_summary, date_ranges, null_and_distinct,
                                 numeric_stats, quantiles, top_values)
from ..operators.timeseries import resample_sums
from ..operators.types import collect_types, column_types
from .profile_queries import LINEITEM_NULLS_SQL, lineitem_nulls
from .tables import load

SPARK, SQL = {}, {}


def register(name, sql=None):
    def deco(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _nochart(df):
    return df.drop("chart_id", "description")


ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"

# ------------------------------------------------------------------ filters
CAT_SPEC = {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}


@register("filter_category", f"""SELECT {ORDERS} FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def q_filter_category(spark, sf):
    return apply_filters(load(spark, sf, "orders"), {"category_filters": CAT_SPEC})


SEMI_VALUES = [f"Customer#{i:09d}" for i in range(0, 6000, 2)]


@register("filter_category_semi", """SELECT * FROM customer WHERE c_name IN
(SELECT 'Customer#' || lpad(CAST(i AS VARCHAR), 9, '0') FROM range(0, 6000, 2) t(i))""")
def q_filter_category_semi(spark, sf):
    return filter_in_values(load(spark, sf, "customer"), "c_name", SEMI_VALUES)


@register("filter_numeric", f"""SELECT {ORDERS} FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 300000""")
def q_filter_numeric(spark, sf):
    return apply_filters(load(spark, sf, "orders"),
                         {"numeric_ranges": {"o_totalprice": {"min": 100000, "max": 300000}}})


@register("filter_numeric_fractional", "SELECT * FROM lineitem WHERE l_linenumber >= 2.5 AND l_linenumber <= 5.5 AND l_orderkey >= -2.5")
def q_filter_numeric_fractional(spark, sf):
    return apply_filters(load(spark, sf, "lineitem"), {"numeric_ranges": {
        "l_linenumber": {"min": 2.5, "max": 5.5}, "l_orderkey": {"min": -2.5}}})


@register("filter_numeric_huge", "SELECT * FROM part WHERE p_size <= 1000000000000 AND p_size >= 25")
def q_filter_numeric_huge(spark, sf):
    return apply_filters(load(spark, sf, "part"), {"numeric_ranges": {"p_size": {"min": 25, "max": 1e12}}})


@register("filter_date", """SELECT * FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-10 00:00:00'""")
def q_filter_date(spark, sf):
    return apply_filters(load(spark, sf, "events"),
                         {"date_ranges": {"ts": {"start": "2024-01-05", "end": "2024-01-10"}}})


@register("filter_date_bad_bound", "SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-03 00:00:00'")
def q_filter_date_bad_bound(spark, sf):
    """A bound that is no date keeps no row; beside it the rows under a good bound."""
    ev = load(spark, sf, "events")
    bad = apply_filters(ev, {"date_ranges": {"ts": {"start": "not a date"}}})
    return bad.unionByName(apply_filters(ev, {"date_ranges": {"ts": {"end": "2024-01-03"}}}))


SEARCH_SQL = """SELECT * FROM customer WHERE
 regexp_matches(lower(CAST(c_custkey AS VARCHAR)), '{q}') OR regexp_matches(lower(c_name), '{q}')
 OR regexp_matches(lower(CAST(c_nationkey AS VARCHAR)), '{q}') OR regexp_matches(lower(CAST(c_acctbal AS VARCHAR)), '{q}')
 OR regexp_matches(lower(c_mktsegment), '{q}')"""


@register("search", SEARCH_SQL.format(q="machin|#00000012|^77"))
def q_search(spark, sf):
    return apply_filters(load(spark, sf, "customer"), {"search_query": "  MACHIN|#00000012|^77 "})


@register("search_bad_pattern", "SELECT * FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'")
def q_search_bad_pattern(spark, sf):
    """A pattern that does not compile is ignored; the other filters hold."""
    return apply_filters(load(spark, sf, "customer"), {
        "search_query": "([unclosed", "numeric_ranges": {"c_acctbal": {"min": 0}}, "category_filters": {"c_mktsegment": ["BUILDING"]}})


@register("apply_filters", f"""SELECT {ORDERS} FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 50000
  AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-12-31'
  AND (regexp_matches(lower(o_orderpriority), 'urgent|high') OR regexp_matches(lower(o_orderstatus), 'urgent|high')
       OR regexp_matches(lower(CAST(o_orderkey AS VARCHAR)), 'urgent|high') OR regexp_matches(lower(CAST(o_custkey AS VARCHAR)), 'urgent|high')
       OR regexp_matches(lower(CAST(o_totalprice AS VARCHAR)), 'urgent|high') OR regexp_matches(lower(CAST(o_orderdate AS VARCHAR)), 'urgent|high'))""")
def q_apply_filters(spark, sf):
    spec = FilterSpec(search_query="urgent|high", category_filters={"o_orderstatus": ["F", "O"], "nope": ["x"]},
                      numeric_ranges={"o_totalprice": {"min": 50000}},
                      date_ranges={"o_orderdate": {"start": "1996-01-01", "end": "1998-12-31"}})
    return apply_filters(load(spark, sf, "orders"), spec)


@register("project", "SELECT o_orderkey, o_orderdate FROM orders")
def q_project(spark, sf):
    return project_columns(load(spark, sf, "orders"), ["o_orderdate", "o_orderkey", "missing"])


@register("facets", """WITH f AS (
  SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS cnt FROM orders GROUP BY 2
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rk FROM f)
SELECT 'category' AS facet, column_name, CAST(rk AS INTEGER) AS ord, value, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi FROM r WHERE rk <= 8
UNION ALL SELECT 'numeric', 'o_orderkey', 0, NULL, min(o_orderkey)::DOUBLE, max(o_orderkey)::DOUBLE FROM orders
UNION ALL SELECT 'numeric', 'o_custkey', 0, NULL, min(o_custkey)::DOUBLE, max(o_custkey)::DOUBLE FROM orders
UNION ALL SELECT 'numeric', 'o_totalprice', 0, NULL, min(o_totalprice), max(o_totalprice) FROM orders
UNION ALL SELECT 'date', 'o_orderdate', 0, strftime(min(o_orderdate), '%Y-%m-%d') || ' .. ' || strftime(max(o_orderdate), '%Y-%m-%d'), NULL, NULL FROM orders""")
def q_facets(spark, sf):
    df = load(spark, sf, "orders")
    freq = frequency_table(df, persist=True)
    types = collect_types(column_types(df, freq=freq))
    num = [t["column_name"] for t in types if t["is_numeric"]]
    dat = [t["column_name"] for t in types if t["is_date"]]
    return facets(types, top_values(freq), numeric_stats(df, num, freq), date_ranges(freq, dat))


# ------------------------------------------------------------------- paging
LI_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_TIES_SQL = ", ".join(c + " NULLS FIRST" for c in LI_TIES)
LI_COLS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
           "l_returnflag, l_linestatus, l_shipdate")


@register("sort_nulls_last", f"""SELECT {LI_COLS},
  row_number() OVER (ORDER BY l_discount ASC NULLS LAST, {LI_TIES_SQL}) AS position FROM {LINEITEM_NULLS_SQL}""")
def q_sort_nulls_last(spark, sf):
    df = lineitem_nulls(spark, sf)
    return with_positions(df, sort_orders(df, "l_discount", "asc", LI_TIES))


@register("sort_desc_nulls_last", f"""SELECT {LI_COLS},
  row_number() OVER (ORDER BY l_tax DESC NULLS LAST, {LI_TIES_SQL}) AS position FROM {LINEITEM_NULLS_SQL}""")
def q_sort_desc_nulls_last(spark, sf):
    df = lineitem_nulls(spark, sf)
    return with_positions(df, sort_orders(df, "l_tax", "desc", LI_TIES))


PAGE_SQL = """SELECT * FROM (SELECT {cols}, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS position
FROM orders) WHERE position > {lo} AND position <= {hi}"""


@register("page", PAGE_SQL.format(cols=ORDERS, lo=50, hi=75))
def q_page(spark, sf):
    df = load(spark, sf, "orders")
    return page(df, 3, 25, sort_orders(df, "o_totalprice", "desc", ["o_orderkey"]))


@register("page_past_end", PAGE_SQL.format(cols=ORDERS, lo=0, hi=25))
def q_page_past_end(spark, sf):
    """A page behind the last one is empty; beside it the first page."""
    df = load(spark, sf, "orders")
    orders = sort_orders(df, "o_totalprice", "desc", ["o_orderkey"])
    return page(df, 10_000_001, 25, orders).unionByName(page(df, 1, 25, orders))


@register("page_info", """SELECT 3::BIGINT AS page, 25::BIGINT AS page_size, count(*)::BIGINT AS total_rows,
  CAST(ceil(count(*) / 25) AS BIGINT) AS total_pages FROM orders""")
def q_page_info(spark, sf):
    return page_info(load(spark, sf, "orders"), 3, 25)


@register("head", f"SELECT {ORDERS} FROM orders ORDER BY o_orderkey LIMIT 10")
def q_head(spark, sf):
    return head(load(spark, sf, "orders"), 10, [F.col("o_orderkey")])


@register("latest_k", "SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 20")
def q_latest_k(spark, sf):
    return latest(load(spark, sf, "events"), "ts", 20)


@register("latest_k_ties", "SELECT date_trunc('day', ts) AS day, event_type, user_id, event_id FROM events ORDER BY 1 DESC, 2, 3, 4 LIMIT 50")
def q_latest_k_ties(spark, sf):
    """L5 where all rows of a day have one time: the other columns decide."""
    ev = load(spark, sf, "events")
    return latest(ev.select(F.date_trunc("day", "ts").alias("day"), "event_type", "user_id", "event_id"), "day", 50)


@register("page_deep", """SELECT * FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber) AS position FROM lineitem)
WHERE position > greatest((SELECT count(*) FROM lineitem) // 100 * 70, 0) AND position <= (SELECT count(*) FROM lineitem) // 100 * 71""")
def q_page_deep(spark, sf):
    """L2 deep in the table through a page index: one page of a hundred, the 71st."""
    from ..operators.paging import PageIndex
    from ..session import scratch_path
    df = load(spark, sf, "lineitem")
    orders = sort_orders(df, "l_extendedprice", "desc", ["l_orderkey", "l_linenumber"])
    index = PageIndex.build(df, orders, scratch_path(spark, "page-index"))
    return index.page(71, df.count() // 100)


# ------------------------------------------------------------------- groups
@register("group_sum", """SELECT cat_column, measure, label, round_even(value, 4) AS value FROM (
  SELECT 'l_returnflag' AS cat_column, 'l_quantity' AS measure, l_returnflag AS label, sum(l_quantity) AS value FROM lineitem GROUP BY 3
  UNION ALL SELECT 'l_returnflag', 'l_extendedprice', l_returnflag, sum(l_extendedprice) FROM lineitem GROUP BY 3
  UNION ALL SELECT 'l_linestatus', 'l_quantity', l_linestatus, sum(l_quantity) FROM lineitem GROUP BY 3
  UNION ALL SELECT 'l_linestatus', 'l_extendedprice', l_linestatus, sum(l_extendedprice) FROM lineitem GROUP BY 3)""")
def q_group_sum(spark, sf):
    g = group_sums(load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])
    return g.select("cat_column", "measure", "label", safe("value", 4).alias("value"))


TOPN_SQL = """WITH g AS (SELECT '{c}' AS cat_column, '{m}' AS measure, CAST({c} AS VARCHAR) AS label, sum({m}) AS value
  FROM {t} WHERE {c} IS NOT NULL AND {m} IS NOT NULL GROUP BY 3),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rk, count(*) OVER () AS ng FROM g)
SELECT cat_column, measure, CAST(CASE WHEN ng <= {n} OR rk < {n} THEN rk ELSE {n} END AS INTEGER) AS rank,
  CASE WHEN ng <= {n} OR rk < {n} THEN label ELSE 'Others' END AS label, round_even(sum(value), 4) AS value
FROM r GROUP BY ALL"""


@register("top_n_others", TOPN_SQL.format(c="p_brand", m="p_retailprice", t="part", n=10))
def q_top_n_others(spark, sf):
    g = group_sums(load(spark, sf, "part"), ["p_brand"], ["p_retailprice"])
    return top_n_with_others(g, ["cat_column", "measure"], 10)


@register("category_counts", """SELECT 'p_type' AS cat_column, p_type AS label, count(*)::DOUBLE AS value FROM part GROUP BY 2
UNION ALL SELECT 'p_brand', p_brand, count(*)::DOUBLE FROM part GROUP BY 2""")
def q_category_counts(spark, sf):
    return category_counts(load(spark, sf, "part"), ["p_type", "p_brand"])


@register("five_number", """SELECT column_name, p, round_even(v, 4) AS value FROM (
  SELECT 'l_quantity' AS column_name, unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS p,
         unnest([min(l_quantity), quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.75), max(l_quantity)]) AS v FROM lineitem
  UNION ALL
  SELECT 'l_extendedprice', unnest([0.0, 0.25, 0.5, 0.75, 1.0]),
         unnest([min(l_extendedprice), quantile_cont(l_extendedprice, 0.25), quantile_cont(l_extendedprice, 0.5), quantile_cont(l_extendedprice, 0.75), max(l_extendedprice)]) FROM lineitem)""")
def q_five_number(spark, sf):
    cols = ["l_quantity", "l_extendedprice"]
    q = quantiles(frequency_table(load(spark, sf, "lineitem"), cols), cols, ps=(0.0, 0.25, 0.5, 0.75, 1.0))
    return q.select("column_name", "p", safe("value", 4).alias("value"))


# --------------------------------------------------------------- resampling
def resample_sql(table: str, d: str, m: str, where: str = "true", granularity: str | None = None) -> str:
    chosen = f"'{granularity}'" if granularity else "CASE WHEN days > 90 THEN 'month' WHEN days > 14 THEN 'week' ELSE 'day' END"
    return f"""WITH r AS (SELECT CAST({d} AS TIMESTAMP) AS ts, CAST({m} AS DOUBLE) AS v FROM {table}
  WHERE {d} IS NOT NULL AND {m} IS NOT NULL AND {where}),
s AS (SELECT min(ts) AS mn, max(ts) AS mx, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS days FROM r),
g AS (SELECT mn, mx, {chosen} AS gran FROM s),
b AS (SELECT CASE WHEN gran = 'month' THEN last_day(CAST(ts AS DATE))
                  WHEN gran = 'week' THEN CAST(ts AS DATE) + CAST((7 - isodow(ts)) % 7 AS INTEGER)
                  ELSE CAST(ts AS DATE) END AS period, v FROM r, g),
sums AS (SELECT period, sum(v) AS value FROM b GROUP BY period),
bounds AS (SELECT gran,
  CASE WHEN gran = 'month' THEN last_day(CAST(mn AS DATE)) WHEN gran = 'week' THEN CAST(mn AS DATE) + CAST((7 - isodow(mn)) % 7 AS INTEGER) ELSE CAST(mn AS DATE) END AS first,
  CASE WHEN gran = 'month' THEN last_day(CAST(mx AS DATE)) WHEN gran = 'week' THEN CAST(mx AS DATE) + CAST((7 - isodow(mx)) % 7 AS INTEGER) ELSE CAST(mx AS DATE) END AS last FROM g),
spine AS (
  SELECT gran, last_day(CAST(unnest(generate_series(date_trunc('month', first), date_trunc('month', last), INTERVAL 1 MONTH)) AS DATE)) AS period FROM bounds WHERE gran = 'month'
  UNION ALL SELECT gran, CAST(unnest(generate_series(first, last, INTERVAL 7 DAY)) AS DATE) FROM bounds WHERE gran = 'week'
  UNION ALL SELECT gran, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) FROM bounds WHERE gran = 'day'),
f AS (SELECT spine.gran, spine.period, coalesce(sums.value, 0.0) AS value FROM spine LEFT JOIN sums USING (period))
SELECT '{d}' AS date_column, '{m}' AS measure, gran AS granularity, CAST(period AS TIMESTAMP) AS period,
  CASE WHEN gran = 'month' THEN strftime(period, '%Y-%m') WHEN gran = 'week' THEN strftime(period, '%Y-%W') ELSE strftime(period, '%Y-%m-%d') END AS label,
  round_even(value, 4) AS value,
  round_even(sum(value) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running_value
FROM f"""


@register("resample_month", resample_sql("orders", "o_orderdate", "o_totalprice"))
def q_resample_month(spark, sf):
    return resample_sums(load(spark, sf, "orders"), [("o_orderdate", "o_totalprice")])


@register("resample_week", resample_sql("events", "ts", "value"))
def q_resample_week(spark, sf):
    return resample_sums(load(spark, sf, "events"), [("ts", "value")])


@register("resample_day", resample_sql("events", "ts", "value", granularity="day"))
def q_resample_day(spark, sf):
    return resample_sums(load(spark, sf, "events"), [("ts", "value")], granularity="day")


@register("running_total", "SELECT label, value, running_value FROM (" +
          resample_sql("orders", "o_orderdate", "o_totalprice") + ")")
def q_running_total(spark, sf):
    return resample_sums(load(spark, sf, "orders"), [("o_orderdate", "o_totalprice")]) \
        .select("label", "value", "running_value")


# ------------------------------------------------------------------- charts
CHART_SEL = "SELECT {t} AS type, {c} AS category, {title} AS title, {xl} AS x_label, {yl} AS y_label, {s} AS series, " \
            "CAST({pos} AS INTEGER) AS pos, {label} AS label, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, " \
            "CAST({z} AS DOUBLE) AS z"


def chart_sql(**kw) -> str:
    base = dict(xl="NULL", yl="NULL", label="NULL", x="NULL", y="NULL", z="NULL")
    base.update(kw)
    return CHART_SEL.format(**base)


@register("chart_line", "SELECT * FROM (" + chart_sql(
    t="'line'", c="'trend'", title="'o_totalprice Trend over o_orderdate'", xl="'o_orderdate'", yl="'o_totalprice'",
    s="'o_totalprice'", pos="row_number() OVER (ORDER BY period) - 1", label="label", y="value")
    + " FROM (" + resample_sql("orders", "o_orderdate", "o_totalprice") + "))")
def q_chart_line(spark, sf):
    df = load(spark, sf, "orders")
    return _nochart(ch.trend_charts(df, ["o_orderdate"], ["o_totalprice"]).where(F.col("type") == "line"))


@register("chart_area", "SELECT * FROM (" + chart_sql(
    t="'area'", c="'trend'", title="'value Cumulative Trend (ts)'", xl="'ts'", yl="'value'",
    s="'value'", pos="row_number() OVER (ORDER BY period) - 1", label="label", y="value", z="running_value")
    + " FROM (" + resample_sql("events", "ts", "value") + "))")
def q_chart_area(spark, sf):
    df = load(spark, sf, "events")
    return _nochart(ch.trend_charts(df, ["ts"], ["value"]).where(F.col("type") == "area"))


def _topn_chart_sql(t, c, m, n, ctype, title, table, xl, yl):
    inner = TOPN_SQL.format(c=c, m=m, t=table, n=n)
    return ("SELECT * FROM (" + chart_sql(t=ctype, c="'comparison'" if ctype != "'pie'" and ctype != "'donut'" else "'distribution'",
                                          title=title, xl=xl, yl=yl, s=f"'{m}'", pos="rank - 1", label="label", y="value")
            + f" FROM ({inner}))")


@register("chart_bar", _topn_chart_sql(None, "p_brand", "p_retailprice", 15,
                                       "CASE WHEN count(*) OVER () > 6 THEN 'horizontal_bar' ELSE 'bar' END",
                                       "'p_retailprice by p_brand'", "part", "'p_brand'", "'p_retailprice'"))
def q_chart_bar(spark, sf):
    df = load(spark, sf, "part")
    out = ch.category_charts(df, ["p_brand"], ["p_retailprice"])
    return _nochart(out.where(F.col("type").isin("bar", "horizontal_bar")))


@register("chart_pie", _topn_chart_sql(None, "p_type", "p_size", 10, "'pie'", "'p_size Distribution by p_type'",
                                       "part", "NULL", "NULL"))
def q_chart_pie(spark, sf):
    df = load(spark, sf, "part")
    return _nochart(ch.category_charts(df, ["p_type"], ["p_size"]).where(F.col("type") == "pie"))


@register("chart_donut", _topn_chart_sql(None, "c_mktsegment", "c_acctbal", 10, "'donut'",
                                         "'c_acctbal Share (c_mktsegment)'", "customer", "NULL", "NULL"))
def q_chart_donut(spark, sf):
    df = load(spark, sf, "customer")
    return _nochart(ch.category_charts(df, ["c_mktsegment"], ["c_acctbal"]).where(F.col("type") == "donut"))


@register("chart_category", """WITH g AS (SELECT p_brand AS label, count(*)::DOUBLE AS value FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rk, count(*) OVER () AS ng FROM g),
t AS (SELECT CAST(CASE WHEN ng <= 10 OR rk < 10 THEN rk ELSE 10 END AS INTEGER) AS rank,
  CASE WHEN ng <= 10 OR rk < 10 THEN label ELSE 'Others' END AS label, round_even(sum(value), 4) AS value FROM r GROUP BY ALL)
""" + chart_sql(t="'donut'", c="'distribution'", title="'p_brand Frequency'", s="'Count'", pos="rank - 1",
                label="label", y="value") + " FROM t")
def q_chart_category(spark, sf):
    return _nochart(ch.frequency_charts(load(spark, sf, "part"), ["p_brand"]))


def _hist_chart_sql():
    from .profile_sql import hist_sql
    inner = hist_sql("lineitem", ["l_extendedprice"]).replace(
        "CAST(round_even(sp.bin * step + first, 2) AS VARCHAR) || ' - ' ||\n  CAST(round_even(CASE WHEN sp.bin + 1 = bins THEN last ELSE (sp.bin + 1) * step + first END, 2) AS VARCHAR)",
        "CAST(round_even(sp.bin * step + first, 4) AS VARCHAR) || ' – ' ||\n  CAST(round_even(CASE WHEN sp.bin + 1 = bins THEN last ELSE (sp.bin + 1) * step + first END, 4) AS VARCHAR)")
    return "SELECT * FROM (" + chart_sql(t="'bar'", c="'distribution'", title="'Histogram of l_extendedprice'",
                                         xl="'l_extendedprice'", yl="'Count'", s="'Frequency'", pos="bin",
                                         label="label", y="count") + f" FROM ({inner}))"


@register("chart_histogram", _hist_chart_sql())
def q_chart_histogram(spark, sf):
    df = load(spark, sf, "lineitem")
    return _nochart(ch.histogram_charts(frequency_table(df, ["l_extendedprice"]), ["l_extendedprice"]))


@register("chart_boxplot", "SELECT * FROM (" + chart_sql(
    t="'boxplot'", c="'distribution'", title="'Boxplot of l_quantity'", xl="'l_quantity'", yl="'l_quantity'",
    s="'l_quantity'", pos="CAST(p * 4 AS INTEGER)", label="['min','q1','median','q3','max'][CAST(p * 4 AS INTEGER) + 1]",
    y="round_even(v, 4)") + """ FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS p,
  unnest([min(l_quantity), quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.75), max(l_quantity)]) AS v FROM lineitem))""")
def q_chart_boxplot(spark, sf):
    df = load(spark, sf, "lineitem")
    return _nochart(ch.boxplot_charts(df, frequency_table(df, ["l_quantity"]), ["l_quantity"]))


@register("chart_scatter", "SELECT * FROM (" + chart_sql(
    t="'scatter'", c="'correlation'", title="'l_quantity vs l_extendedprice'", xl="'l_quantity'", yl="'l_extendedprice'",
    s="'l_quantity vs l_extendedprice'", pos="rk - 1", x="round_even(l_quantity, 4)", y="round_even(l_extendedprice, 4)")
    + " FROM (SELECT *, row_number() OVER (ORDER BY " + LI_TIES_SQL + """) AS rk FROM lineitem
    WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) WHERE rk <= 500)""")
def q_chart_scatter(spark, sf):
    df = load(spark, sf, "lineitem")
    return _nochart(ch.scatter_charts(df, ["l_quantity", "l_extendedprice"], [F.col(c) for c in LI_TIES]))


def _heat_sql():
    from .profile_sql import corr_sql
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return "SELECT * FROM (" + chart_sql(t="'heatmap'", c="'correlation'", title="'Correlation Heatmap'",
                                         s="'Correlation'", pos="pos_y * 4 + pos_x", label="col_x || ' / ' || col_y",
                                         x="pos_x", y="pos_y", z="r") + f" FROM ({corr_sql('lineitem', cols)}))"


@register("chart_heatmap", _heat_sql())
def q_chart_heatmap(spark, sf):
    df = load(spark, sf, "lineitem")
    return _nochart(ch.heatmap_chart(correlation(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4))


@register("chart_texts", """SELECT * FROM (VALUES
  ('line', 'o_totalprice Trend over o_orderdate', 'Line trend of o_totalprice over o_orderdate.'),
  ('area', 'o_totalprice Cumulative Trend (o_orderdate)', 'Area chart showing o_totalprice accumulation over time.'),
  ('bar', 'o_totalprice by o_orderstatus', 'Comparison of o_totalprice across o_orderstatus categories.'),
  ('pie', 'o_totalprice Distribution by o_orderstatus', 'Pie chart breakdown of o_totalprice across o_orderstatus.'),
  ('donut', 'o_totalprice Share (o_orderstatus)', 'Donut chart showing proportional share of o_totalprice.'),
  ('bar', 'Histogram of o_totalprice', 'Binned frequency distribution for o_totalprice.'),
  ('boxplot', 'Boxplot of o_totalprice', 'Five-number summary (Min, Q1, Median, Q3, Max) for o_totalprice.'),
  ('donut', 'o_orderstatus Frequency', 'Distribution count across o_orderstatus.'),
  ('scatter', 'o_totalprice vs o_custkey', 'Relationship between o_totalprice and o_custkey.'),
  ('heatmap', 'Correlation Heatmap', 'Pearson correlation matrix across numeric fields.')) v(type, title, description)
WHERE EXISTS (SELECT 1 FROM orders)""")
def q_chart_texts(spark, sf):
    """Types, titles and descriptions of all chart families of one table."""
    df = load(spark, sf, "orders")
    freq = frequency_table(df, ["o_totalprice", "o_custkey"], persist=True)
    sets = [ch.trend_charts(df, ["o_orderdate"], ["o_totalprice"]), ch.category_charts(df, ["o_orderstatus"], ["o_totalprice"]),
            ch.histogram_charts(freq, ["o_totalprice"]), ch.boxplot_charts(df, freq, ["o_totalprice"]), ch.frequency_charts(df, ["o_orderstatus"]),
            ch.scatter_charts(df, ["o_totalprice", "o_custkey"], [F.col("o_orderkey")]), ch.heatmap_chart(correlation(df, ["o_totalprice", "o_custkey"]), 2)]
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return out.select("type", "title", "description").distinct()


@register("chart_scatter_gaps", f"""WITH p AS (SELECT *, l_quantity AS a, CASE WHEN l_linenumber <> 1 THEN l_discount END AS b,
  CASE WHEN l_linenumber = 1 THEN l_extendedprice END AS c FROM lineitem),
r AS (SELECT 'a vs b' AS title, a AS x, b AS y, row_number() OVER (ORDER BY {LI_TIES_SQL}) AS k FROM p WHERE a IS NOT NULL AND b IS NOT NULL
  UNION ALL SELECT 'a vs c', a, c, row_number() OVER (ORDER BY {LI_TIES_SQL}) FROM p WHERE a IS NOT NULL AND c IS NOT NULL)
SELECT title, CAST(k - 1 AS INTEGER) AS pos, x, y FROM r WHERE k <= 500""")
def q_chart_scatter_gaps(spark, sf):
    """Pairs with gaps of their own; a pair without a complete row has no chart."""
    first = F.col("l_linenumber") == 1
    df = load(spark, sf, "lineitem").withColumns({"a": F.col("l_quantity"), "b": F.when(~first, F.col("l_discount")),
                                                  "c": F.when(first, F.col("l_extendedprice"))})
    points = ch.scatter_charts(df, ["a", "b", "c"], [F.col(c) for c in LI_TIES])
    return points.select("title", "pos", "x", "y")


@register("warnings", """SELECT 'Search pattern ''['' is not a valid regular expression; search ignored.' AS warning WHERE EXISTS (SELECT 1 FROM orders)
UNION ALL SELECT 'Column ''ratio'' could not be fully analyzed: ' || count(*) FILTER (WHERE o_orderkey % 11 = 0) || ' infinite values' FROM orders
UNION ALL SELECT 'Column ''raw'' could not be fully analyzed: type binary is profiled as text' WHERE EXISTS (SELECT 1 FROM orders)
UNION ALL SELECT 'Histogram of rare skipped: 2 values' WHERE EXISTS (SELECT 1 FROM orders)
UNION ALL SELECT 'Boxplot of rare skipped: 2 values' WHERE EXISTS (SELECT 1 FROM orders)""")
def q_warnings(spark, sf):
    """A bad search pattern, a column with infinite values, one of a type that is only profiled as text, skipped charts."""
    from .analyze import analyze
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    two = o.agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b")).first()
    df = o.select("o_totalprice", F.when(k % 11 == 0, F.lit(float("inf"))).otherwise(k / 7).alias("ratio"),
                  F.col("o_orderstatus").cast("binary").alias("raw"), F.when(k.isin(two["a"], two["b"]), F.col("o_totalprice")).alias("rare"))
    return analyze(df, {"search_query": "["})["warnings"]


@register("chart_points")
def q_chart_points(spark, sf):
    """Every recommended chart of orders (all families stacked)."""
    df = load(spark, sf, "orders")
    freq = frequency_table(df, persist=True)
    types = collect_types(column_types(df, freq=freq))
    num = ch.chart_columns(types)["numeric"]
    return ch.chart_points(df, types, [F.col("o_orderkey")], correlation(df, num), freq)


@register("custom_chart", """WITH g AS (SELECT o_orderpriority AS label, sum(coalesce(o_totalprice, 0)) AS s, min(o_orderkey) AS first
  FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderpriority <> '' GROUP BY 1 ORDER BY first LIMIT 15)
""" + chart_sql(t="'bar'", c="'custom'", title="'o_totalprice across o_orderpriority'", xl="'o_orderpriority'",
                yl="'o_totalprice'", s="'o_totalprice'", pos="row_number() OVER (ORDER BY first) - 1",
                label="label", y="floor(s * 100 + 0.5) / 100") + " FROM g")
def q_custom_chart(spark, sf):
    df = load(spark, sf, "orders")
    return _nochart(ch.custom_chart(df, "o_orderpriority", "o_totalprice", "bar", [F.col("o_orderkey")]))


@register("custom_chart_pie", """WITH g AS (SELECT coalesce(CAST(c_nationkey AS VARCHAR), 'Unknown') AS label, count(*)::DOUBLE AS s,
  min(c_custkey) AS first FROM customer GROUP BY 1 ORDER BY first LIMIT 10)
""" + chart_sql(t="'pie'", c="'custom'", title="'Count by c_nationkey'", xl="'c_nationkey'", yl="NULL", s="'Count'",
                pos="row_number() OVER (ORDER BY first) - 1", label="label", y="s") + " FROM g")
def q_custom_chart_pie(spark, sf):
    df = load(spark, sf, "customer")
    return _nochart(ch.custom_chart(df, "c_nationkey", None, "pie", [F.col("c_custkey")]))


@register("custom_boxplot", """WITH v AS (SELECT coalesce(CAST(p_size AS DOUBLE), 0) AS x, row_number() OVER (ORDER BY coalesce(CAST(p_size AS DOUBLE), 0)) - 1 AS i,
  count(*) OVER () AS n FROM part),
k AS (SELECT unnest([0, 1, 2, 3, 4]) AS pos, unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS p)
""" + chart_sql(t="'boxplot'", c="'custom'", title="'Boxplot of p_size'", yl="'p_size'", s="'p_size'", pos="pos",
                label="['min','q1','median','q3','max'][pos + 1]", y="x") + """ FROM k JOIN v ON v.i = CASE WHEN k.p = 1.0 THEN v.n - 1 ELSE floor(v.n * k.p) END""")
def q_custom_boxplot(spark, sf):
    return _nochart(ch.custom_boxplot(load(spark, sf, "part"), "p_size"))


# ------------------------------------------------------------------ insights
@register("insights")
def q_insights(spark, sf):
    """I1-I6 over lineitem with derived missing values."""
    return _insights_of(lineitem_nulls(spark, sf))


def _insights_of(df):
    freq = frequency_table(df, persist=True)
    types_df = column_types(df, freq=freq)
    types = collect_types(types_df)
    num = [t["column_name"] for t in types if t["is_numeric"] and not t["is_id"]]
    cat = [t["column_name"] for t in types if t["is_categorical"] or t["detected_type"] in
           ("Category", "Boolean", "Text", "Unique IDs")]
    summary = dataset_summary(df, types_df, freq)
    stats = numeric_stats(df, num, freq).select("column_name", "outliers_count")
    nd = null_and_distinct(freq).join(column_counts(freq).select("column_name", "total_rows"), "column_name")
    cstats = nd.join(stats, "column_name", "left")
    top1 = top_values(freq, cat, k=1)
    return insights(summary, cstats, correlation(df, num), top1)


#: orders with repeated rows, a half-empty column, two columns that rise together, far values and one common status.
ALL_RULES_SQL = """(SELECT o_totalprice AS paid, o_totalprice * 2 + 1 AS charged, o_orderkey % 7 AS step,
  CASE WHEN o_orderkey % 20 = 0 THEN 1e6 + o_custkey ELSE o_custkey % 10 END AS spike,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS gap, CASE WHEN o_orderkey % 10 < 6 THEN 'usual' ELSE o_orderstatus END AS state
FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0))"""
ALL_RULES_KINDS = {"paid": "fractional", "charged": "fractional", "step": "integral", "spike": "fractional", "gap": "string", "state": "string"}


def all_rules_table(spark, sf):
    o = load(spark, sf, "orders")
    o = o.unionByName(o.where(F.col("o_orderkey") % 10 == 0))
    k = F.col("o_orderkey")
    return o.select(F.col("o_totalprice").alias("paid"), (F.col("o_totalprice") * 2 + 1).alias("charged"), (k % 7).alias("step"),
                    F.when(k % 20 == 0, F.lit(1e6) + F.col("o_custkey")).otherwise(F.col("o_custkey") % 10).alias("spike"),
                    F.when(k % 2 == 0, F.col("o_orderpriority")).alias("gap"),
                    F.when(k % 10 < 6, "usual").otherwise(F.col("o_orderstatus")).alias("state"))


@register("insights_all_rules")
def q_insights_all_rules(spark, sf):
    """A table in which all six rules fire: duplicates, gaps, a strong correlation, outliers, a dominant value."""
    return _insights_of(all_rules_table(spark, sf))


def _insights_sql(t: str = LINEITEM_NULLS_SQL, kinds: dict | None = None) -> str:
    from .profile_sql import LINEITEM_KINDS, LINEITEM_NUM, corr_sql, summary_sql, union
    if kinds is not None:
        LINEITEM_KINDS, LINEITEM_NUM = kinds, [c for c, k in kinds.items() if k != "string"]
    cats = [c for c, k in LINEITEM_KINDS.items() if k == "string"]
    nulls = union(list(LINEITEM_KINDS), "SELECT '{c}' AS column_name, {i} AS pos, count(*) AS total_rows, "
                  "round_even((count(*) - count({c})) / greatest(count(*), 1) * 100, 2) AS null_percentage FROM " + t)
    outl = union(LINEITEM_NUM, "SELECT '{c}' AS column_name, count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS oc "
                 "FROM (SELECT CAST({c} AS DOUBLE) AS x FROM " + t + ") v, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, "
                 "quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM " + t + ") b")
    pos = {c: i for i, c in enumerate(LINEITEM_KINDS)}
    top1 = "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column_name, {pos[c]} AS pos, value, round_even(cnt / total * 100, 2) AS pct FROM (
  SELECT CAST({c} AS VARCHAR) AS value, count(*) AS cnt, sum(count(*)) OVER () AS total,
  row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS r FROM {t} WHERE {c} IS NOT NULL GROUP BY 1) WHERE r = 1"""
        for c in cats)
    return f"""WITH s AS ({summary_sql(t, LINEITEM_KINDS)}),
n AS ({nulls}), o AS ({outl}), c AS ({corr_sql(t, LINEITEM_NUM)}), tp AS ({top1}),
i1 AS (SELECT 1 AS rule, 'summary' AS type,
  CASE WHEN NOT (missing_percentage < 2 AND duplicate_rows = 0) AND NOT missing_percentage < 10 THEN 'warning' ELSE 'info' END AS severity,
  'Dataset health is ' || CASE WHEN missing_percentage < 2 AND duplicate_rows = 0 THEN 'excellent' WHEN missing_percentage < 10 THEN 'good' ELSE 'attention' END AS title,
  'Analyzed ' || format('{{:,}}', total_rows) || ' rows with ' || CAST(missing_percentage AS VARCHAR) || '% missing cells and '
    || format('{{:,}}', duplicate_rows) || ' duplicate rows.' AS description FROM s),
i2 AS (SELECT 2, 'quality', 'warning', 'Duplicate rows detected',
  format('{{:,}}', duplicate_rows) || ' duplicate rows were found and should be reviewed.' FROM s WHERE duplicate_rows > 0),
i3 AS (SELECT 3, 'quality', 'warning', 'Columns with substantial missing data',
  string_agg(column_name || ' (' || CAST(null_percentage AS VARCHAR) || '%)', ', ' ORDER BY pos) FROM
  (SELECT * FROM n WHERE null_percentage >= 20 ORDER BY pos LIMIT 5) HAVING count(*) > 0),
i4 AS (SELECT 4, 'correlation', 'success', 'Strong ' || CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END || ' relationship found',
  col_x || ' and ' || col_y || ' have a correlation of ' || printf('%.2f', r) || '.' FROM
  (SELECT * FROM c WHERE pos_x < pos_y AND abs(r) >= 0.7 ORDER BY abs(r) DESC, pos_x, pos_y LIMIT 1)),
i5 AS (SELECT 5, 'outlier', 'warning', 'Outliers in ' || o.column_name,
  format('{{:,}}', oc) || ' values fall outside the 1.5x IQR boundary.' FROM
  (SELECT o.*, n.pos, n.total_rows FROM o JOIN n USING (column_name)
   WHERE oc > 0 AND round_even(oc / greatest(n.total_rows, 1) * 100, 1) >= 3 ORDER BY n.pos LIMIT 1) o),
i6 AS (SELECT 6, 'distribution', 'info', 'Dominant category in ' || column_name,
  value || ' accounts for ' || CAST(pct AS VARCHAR) || '% of the column.' FROM
  (SELECT * FROM tp WHERE pct >= 40 ORDER BY pos LIMIT 1)),
a AS (SELECT * FROM i1 UNION ALL SELECT * FROM i2 UNION ALL SELECT * FROM i3 UNION ALL SELECT * FROM i4
      UNION ALL SELECT * FROM i5 UNION ALL SELECT * FROM i6)
SELECT CAST(row_number() OVER (ORDER BY rule) - 1 AS INTEGER) AS ord, type, severity, title, description FROM a"""


SQL["insights"] = _insights_sql()
SQL["insights_all_rules"] = _insights_sql(ALL_RULES_SQL, ALL_RULES_KINDS)


@register("report_insights", """SELECT type AS "Type", severity AS "Severity", title AS "Title", description AS "Description" FROM (""" + SQL["insights_all_rules"] + ")")
def q_report_insights(spark, sf):
    """The insights table of a written report, read back."""
    return _written_report(spark, all_rules_table(spark, sf), "insights")


@register("report_data", f"SELECT {ORDERS} FROM orders")
def q_report_data(spark, sf):
    """The data table of a written report, read back."""
    return _written_report(spark, load(spark, sf, "orders"), "data")


def _written_report(spark, df, name):
    from ..session import scratch_path
    from .analyze import analyze
    from .report import write_report
    return spark.read.parquet(write_report(analyze(df), df, scratch_path(spark, "report"))[name])


def _column_detail_sql() -> str:
    from .profile_sql import hist_sql
    hist = hist_sql("orders", ["o_totalprice"])
    return f"""SELECT 'distribution' AS kind, column_name, bin AS pos, label, CAST(count AS DOUBLE) AS value FROM ({hist})
UNION ALL
SELECT 'top', 'o_orderpriority', CAST(r - 1 AS INTEGER), value, CAST(cnt AS DOUBLE) FROM (
  SELECT o_orderpriority AS value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS r
  FROM orders GROUP BY 1) WHERE r <= 10"""


@register("column_detail", _column_detail_sql())
def q_column_detail(spark, sf):
    """Detail charts of one numeric column (distribution buckets) and one
    categorical column (top-10 bars)."""
    df = load(spark, sf, "orders")
    freq = frequency_table(df, ["o_totalprice", "o_orderpriority"], persist=True)
    from ..operators.profile import histogram
    h = histogram(freq, ["o_totalprice"]).select(F.lit("distribution").alias("kind"), "column_name",
                                                 F.col("bin").alias("pos"), "label",
                                                 F.col("count").cast("double").alias("value"))
    t = top_values(freq, ["o_orderpriority"]).select(F.lit("top").alias("kind"), "column_name",
                                                      (F.col("rank") - 1).alias("pos"), F.col("value").alias("label"),
                                                      F.col("count").cast("double").alias("value"))
    return h.unionByName(t)


@register("page_keyset", """SELECT * FROM events WHERE event_id > 4321 ORDER BY event_id LIMIT 25""")
def q_page_keyset(spark, sf):
    """L2 keyset paging: the 25 events after a known key (no offset scan)."""
    from ..operators.paging import page_after
    return page_after(load(spark, sf, "events"), "event_id", 4321, 25)


@register("first_pairs", """SELECT CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders
WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL ORDER BY o_orderkey LIMIT 500""")
def q_first_pairs(spark, sf):
    """L4: the first 500 rows (in key order) where both values are present."""
    from ..operators.paging import first_complete_pairs
    return first_complete_pairs(load(spark, sf, "orders"), "o_custkey", "o_totalprice", 500, [F.col("o_orderkey")])
