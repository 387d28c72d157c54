import random

import pytest
from pyspark.sql import functions as F

from newsweave.llm import urlrules as ur


def slow(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


@pytest.mark.parametrize("ranges", [1, 2, 13])
def test_against_every_rule(spark, ranges):
    rng = random.Random(ranges)
    labels, ends = ["a", "b", "ab", "www", "x-y", "com", "net", "é"], ["", "/", "/a", "/a/b", "/b/", "/a?x=/b", "#/a"]
    rules = [(".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))), rng.choice(["", "/", "/a", "/a/", "/a/b"]), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = ["http://" + ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5))) + rng.choice(ends) for _ in range(600)]
    urls += ["http://hot.com/a"] * 300 + [None, "", "no scheme", "://", "x://", "HTTP://WWW.A.COM/A", "http://a.com:80/", "http://u@a.com/", "a://b://c/", "http://\nx.com/\n?", "http://.com/"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("clash"), "note": F.lit(1)})
    got = ur.judge(table, spark.createDataFrame(rules + [("", "/", "block")], "host string, path string, verdict string"), ranges=ranges).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == slow(r["url"], rules), r


def test_empty_tables(spark):
    rules = spark.createDataFrame([("com", None, "block")], "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://a.com"), (1, "http://a.com"), (2, "http://a.net")], "page_id long, url string")
    assert sorted(r["verdict"] for r in ur.judge(urls, rules).collect()) == ["allow", "block", "block"]
    assert ur.judge(urls.limit(0), rules).collect() == []
    assert {r["verdict"] for r in ur.judge(urls, rules.limit(0), default="block").collect()} == {"block"}
