"""Url rules against a plain version: nested hosts and paths, odd urls, hot hosts, many ranges."""
import random
import re

import pytest

from tablescope.llm import url_rules as ur
from tablescope.llm.queries import URL_RULES


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, None, default)
    return host, path, best[2], best[3]


ODD = [None, "", "no scheme", "http://", "http:///x", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com", "http://example.com?/en/",
       "http://example.com/en", "http://example.com/en/", "http://a.example.com/en/x://y/", "x://net/es/", "x://a.net/fr/1", "x://bnet/fr/",
       "x://com./a", "x://.com/a", "x://a..com/a", "x://com:80/a", "x://ÄÖ.com/é", "x://www.example.com/en/\nz", "q://EXAMPLE.com#/en/", "a/b://com/"]


def check(spark, urls, rules):
    df = spark.createDataFrame([(i % 7, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = ur.rule_table(spark, rules)
    got = sorted(map(str, (tuple(r) for r in ur.judge(df, table).collect())))
    assert got == sorted(str((i % 7, *plain(u, rules))) for i, u in enumerate(urls))
    kept = ur.filter_rows(df, table)
    assert kept.columns == df.columns
    assert sorted(str(r.url) for r in kept.collect()) == sorted(str(u) for u in urls if plain(u, rules)[3] != "block")


def test_given_rules(spark):
    check(spark, ODD * 2, URL_RULES)


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_random_rules_over_ranges(spark, partitions):
    rng = random.Random(8)
    label, part = ["com", "net", "a", "b", "ab", "www"], ["/", "/a", "/a/", "/a/b", "/ab", "", "/a/b/c", "/b/"]

    def host():
        return ".".join(rng.choice(label) for _ in range(rng.randint(1, 4)))
    rules = list({(host(), rng.choice(part)): v for v in ("allow", "block") for _ in range(60)}.items())
    rules = [(h, p, rng.choice(["allow", "block"])) for (h, p), _ in rules]
    urls = [f"http://{host()}{rng.choice(part)}{rng.choice(part)}{rng.choice(['', '?q=/a', '#x'])}" for _ in range(1500)]
    urls += ["https://a.com/a/b/c"] * 900 + ["x://a.b.com/" + "p/" * 20_000] + ODD
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, urls, rules)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rules_that_disagree_or_are_missing(spark):
    df = spark.createDataFrame([(1, "x://a.b/c"), (2, None)], "page_id long, url string")
    twice = ur.rule_table(spark, [("b", "/", "block"), ("b", "/", "allow"), ("", "/", "block"), (None, None, "block")])
    assert {r.page_id: (r.rule, r.verdict) for r in ur.judge(df, twice).collect()} == {1: ("b/", "block"), 2: (None, "allow")}
    everything = ur.rule_table(spark, [("b", None, "block")])
    assert [r.rule for r in ur.judge(df, everything).orderBy("page_id").collect()] == ["b", None]
    none = twice.where("false")
    assert [r.verdict for r in ur.judge(df, none, default="block").collect()] == ["block", "block"]
    assert ur.judge(df.where("false"), twice).count() == 0
    with pytest.raises(ValueError):
        ur.judge(df.withColumnRenamed("page_id", "rule"), twice, keep=("rule",))


def test_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "x://a.b/c")], "page_id long, url string")
    df.write.mode("overwrite").parquet(spark.sparkContext.getCheckpointDir() + "/urls")
    pages = spark.read.parquet(spark.sparkContext.getCheckpointDir() + "/urls")
    plan = ur.judge(pages, ur.rule_table(spark, URL_RULES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)
