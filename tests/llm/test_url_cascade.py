import random

import pytest

from visitlake.llm.queries import URL_RULES
from visitlake.llm.url_cascade import build_cascade, is_listed, judge_urls
from pyspark.sql import functions as F


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, tail = rest[:end], rest[end:]
        stop = min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])
        path = tail[:stop]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits) if fits else (0, None, "allow")
    return host, path, rule, verdict


URLS = [None, "", "no scheme example.org/es/", "http://EXAMPLE.org/es/x", "https://a.example.org/en/12?q#f", "http://badexample.org/es/", "http://org",
        "http://x.com/fr/", "http://x.com/de", "http://x.com/de/?a", "x://y://org/z", "http://example.org#/es/", "http://üx.ORG/\n/é", "http:///es/",
        "http://example.org./es/", "http://a..org/"]


@pytest.mark.parametrize("rules", [URL_RULES, [], [("block", "org", "")], [("allow", "a.org", "/x"), ("block", "a.org", "/x")]])
def test_as_brute_force(spark, rules):
    urls = URLS * 2 + ["http://a.org/x", "http://a.org/xy"]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, rules).collect()}
    expected = {i: brute(u, rules) for i, u in enumerate(urls)}
    if len(rules) == 2:
        expected = {i: (*e[:3], "block" if e[2] else "allow") for i, e in expected.items()}
    assert got == expected
    assert judge_urls(df.limit(0), rules).count() == 0


def test_cascade_is_exact_over_the_universe(spark):
    random.seed(3)
    universe = [f"k{i}" for i in range(5_000)]
    listed = random.sample(universe, 300) + ["not in the corpus"]
    frame = spark.createDataFrame([(k,) for k in universe + listed[:5] + [None]], "key string")
    levels = build_cascade(spark.createDataFrame([(k,) for k in listed + listed[:3]], "key string"), frame)
    assert len(levels) > 2
    got = {r.key for r in frame.where(is_listed(levels, F.col("key"))).collect()}
    assert got == set(listed) - {"not in the corpus"}
    assert sum(level.bits for level in levels) < 300 * 64  # follows the list


def test_very_long_urls(spark):
    rules = [("block", "a.org", "/x"), ("allow", "org", "/")]
    urls = ["http://a.org/x" + "y" * 500_000, "http://" + "b" * 100_000 + ".org/x", "http://a.org/" + "z" * 300_000 + "?x", "x" * 400_000]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)} and [got[i][3] for i in range(4)] == ["block", "allow", "allow", "allow"]
