"""Allow and block rules on urls by a sort-merge range join.

The host of a url is what stands between the first ``://`` and the next ``/``, ``?``,
``#`` or the end, A-Z in lower case; its path goes on from there to ``?``, ``#`` or the
end. A rule (host, path, verdict) fits a url if the url's host is the rule's host or
a subdomain of it and the url's path starts with the rule's path. The longest
fitting rule (letters of host and path, then of the host) gives the verdict;
urls that no rule fits get the default.

A host becomes a canonical key, its labels in reverse order with a dot behind each
(``www.example.com``: ``com.example.www.``), so a host with all its subdomains is the
interval of the keys that begin with its own key. Two sweeps run over sorted
events, each a union of points (urls) and interval starts (rules):

1. over host keys: every url gets the stack of nested rule hosts around it,
2. over (rule host, path) keys, a url once for each host on its stack: every such
   point gets the longest rule path around it.

A sweep sorts by ranges over (key, kind, row), so urls of one host, even equal urls,
are dealt over several ranges, and scans each range once. Intervals of prefixes nest
or lie apart, so the stack has one slot for each nesting level: the rule of that level
that began last is active as long as its key is a prefix of the point's key. What
is on the stack where a range begins comes from the ranges before it, one row
for each range. Nothing but that is broadcast, no key is joined, and the rules may
be as many as the urls. Everything runs in DataFrame functions.

Edge cases: null urls and urls without ``://`` have an empty host and path and get the
default, as a rule has a host (rows without one are ignored); a null rule path is empty
and fits every path; of equal rules that disagree, block wins over allow (the
greatest verdict); repeated rows are judged each on its own; very long urls are only
strings; without rules all get the default; an empty table gives an empty result;
other columns are ignored by ``judge`` unless named in ``keep`` and kept by ``filter_rows``.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import fresh, prepare, written

ALLOW, BLOCK = "allow", "block"
#: Verdict of urls that no rule fits.
DEFAULT = ALLOW
OUT = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def host_key(host: Column) -> Column:
    labels = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    return F.when(F.length(host) > 0, labels).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows of a list of rules."""
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def nested(rules: DataFrame) -> DataFrame:
    """The rules (key, rule) with ``level``: how many keys of rules their key begins with, itself included."""
    prefix = F.explode(F.transform(F.sequence(F.lit(0), F.length("key")), lambda n: F.substr("key", F.lit(1), n)))
    levels = rules.select("key", prefix.alias("_prefix")).join(rules.select(F.col("key").alias("_prefix")), "_prefix", "left_semi")
    return rules.join(levels.groupBy("key").agg(F.count("*").alias("level")), "key")


def sweep(points: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """The points (key, row, ...) with ``stack``: the rules around them, outermost first.

    ``rules`` (key, rule, with distinct keys) are the intervals of all keys that begin with theirs.
    """
    rules = written(nested(rules), f"{name}-rules")
    depth = rules.agg(F.max("level").alias("d")).first()["d"] or 0
    kind = dict(rules.dtypes)["rule"]
    if not depth:
        return points.withColumn("stack", F.array().cast(f"array<{kind}>"))
    starts = rules.select("key", "level", "rule")
    for c, t in points.dtypes:
        if c != "key":
            starts = starts.withColumn(c, F.lit(None).cast(t))
    events = points.withColumns({"level": F.lit(None).cast("long"), "rule": F.lit(None).cast(kind)}).unionByName(starts)
    order = [F.col("key"), F.col("level").asc_nulls_last(), F.col("row")]
    ranges = written(events.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    slots = range(1, depth + 1)
    entry = F.struct("key", "rule")
    # the last rule of each level in a range, then in all ranges before it: one row for each range
    ends = ranges.groupBy("_range").agg(*(F.max(F.when(F.col("level") == d, F.col("key"))).alias(f"_k{d}") for d in slots),
                                        *(F.max_by(F.when(F.col("level") == d, entry), F.when(F.col("level") == d, F.col("key"))).alias(f"_e{d}")
                                          for d in slots))
    so_far = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_range", *(F.last(f"_e{d}", True).over(so_far).alias(f"_c{d}") for d in slots))
    scan = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranges.select("*", *(F.last(F.when(F.col("level") == d, entry), True).over(scan).alias(f"_s{d}") for d in slots))
    swept = swept.where("level IS NULL").join(F.broadcast(carried), "_range", "left")
    around = [F.coalesce(f"_s{d}", f"_c{d}") for d in slots]
    stack = F.filter(F.array(*(F.when(F.startswith(F.col("key"), a["key"]), a["rule"]) for a in around)), lambda r: r.isNotNull())
    return swept.select(*points.columns, stack.alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = DEFAULT) -> DataFrame:
    """(``keep``..., host, path, rule, verdict), one row per input row."""
    prepare(pages.sparkSession)
    if {c.lower() for c in keep} & set(OUT):
        raise ValueError(f"kept columns may not be named {OUT}")
    rules = rules.where(F.length("host") > 0).select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    node, path = host_key(F.col("host")), F.col("path")
    text = F.concat("host", "path")
    paths = rules.select(F.concat(node, F.lit("/"), path).alias("key"),
                         F.struct(F.length(text).alias("length"), F.length("host").alias("host_length"), text.alias("text"),
                                  F.col("verdict").alias("verdict")).alias("rule"))
    hosts = rules.select(node.alias("key"), node.alias("rule")).distinct()
    host, url_path = host_and_path(F.col(f"`{url_col}`"))
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"),
                        host.alias("host"), url_path.alias("path"))
    points = sweep(urls.withColumn("key", host_key(F.col("host"))), hosts, "hosts")
    # a url without a rule's host around it goes on as one point that no rule fits
    points = points.withColumn("node", F.explode_outer("stack")).drop("stack", "key")
    points = points.withColumn("key", F.coalesce(F.concat("node", F.lit("/"), "path"), F.lit(""))).drop("node")
    found = sweep(points, paths, "paths").withColumn("rule", F.try_element_at("stack", F.lit(-1)))
    best = found.groupBy("row").agg(F.first("kept").alias("kept"), F.first("host").alias("host"), F.first("path").alias("path"),
                                    F.max("rule").alias("rule"))
    return best.select("kept.*", "host", "path", F.col("rule.text").alias("rule"),
                       F.coalesce("rule.verdict", F.lit(default)).alias("verdict"))


def filter_rows(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """The rows whose url is not blocked, with all their columns."""
    (mine,) = fresh(pages, "judged_url")
    urls = pages.select(F.col(f"`{url_col}`").alias(mine)).distinct()
    blocked = judge(urls, rules, mine, (mine,), default).where(F.col("verdict") == BLOCK).select(mine)
    return pages.join(blocked, F.col(f"`{url_col}`").eqNullSafe(F.col(mine)), "left_anti")
