import random

import pytest

from vecindario.llm import url_rules as U
from vecindario.llm.query_urls import RULES


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def checked(spark, urls, rules, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        pages = spark.createDataFrame([(i, u, "clash", 3) for i, u in enumerate(urls)], "page_id long, url string, rule string, extra int")
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        out = U.judge(pages, table)
        assert out.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict"]
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


URLS = [None, "", "no scheme", "http://", "http:///x", "HTTPS://WWW.Example.ORG/en/1", "http://example.org", "http://example.org?x=/es/",
        "http://a.b.example.org/es/é?q#f", "http://notexample.org/es/", "http://x.com/fr/a", "http://com/de/", "http://x.com:80/de/", "a://b://c.org/x",
        "http://.org/", "http://org./x", "http://x.net/a\nb"]


@pytest.mark.parametrize("parts", [1, 7])
def test_contract_rules(spark, parts):
    checked(spark, URLS * 2, RULES, parts)


def test_nested_rules_over_many_partitions(spark):
    random.seed(5)
    hosts = ["a", "b.a", "c.b.a", "b", "a.b", "c"]
    rules = list({(h, p): (h, p, random.choice(["allow", "block"])) for h in hosts for p in ["", "/", "/x", "/x/", "/x/y", "/x/y/z1", "/w"] if random.random() < 0.6}.values())
    urls = [f"http://{random.choice(['', 'd.', 'c.', 'b.'])}{random.choice(hosts)}/{random.choice(['x', 'x/', 'x/y', 'x/y/z1/2', 'w', '', 'v'])}" for _ in range(600)]
    checked(spark, urls + ["http://c.b.a/x/y/hot"] * 400, rules, 23)


def test_empty_tables(spark):
    checked(spark, ["http://a/x"], [("b", "/", "block")], 2)
    pages = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert U.judge(pages, none).count() == 0
    assert U.judge(spark.createDataFrame([(1, "http://a/x")], "page_id long, url string"), none).first().verdict == "allow"
