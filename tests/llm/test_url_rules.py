import random
import re

import pytest

from tonescope.llm import url_rules

LABELS, SEGMENTS = ["a", "b", "net", "org", "example"], ["en", "de", "e", "", "x%20y", "é"]


def expected(url, rules, otherwise="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c in url_rules.UPPER else c for c in host)
    fits = [(len(h), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, otherwise))
    return host, path, best[3], best[4]


def invented(n=1500):
    r = random.Random(5)
    host = lambda: ".".join(r.choices(LABELS, k=r.randint(1, 4)))
    path = lambda: "".join("/" + s for s in r.choices(SEGMENTS, k=r.randint(0, 4)))
    rules = [(host(), path(), r.choice(["allow", "block"])) for _ in range(120)]
    urls = [f"{r.choice(['http', 'HTTPS', ''])}://{host()}{path()}{r.choice(['', '/', '?q=/en', '#/de', '?u=http://net/'])}" for _ in range(n)]
    urls += [None, "", "net/", "mailto:x", "://", "http://", "http://NET", "http://Net/", "http://ÄNET/", "http://xnet/", "http://.net/", "http://net./", "http://u@a.net:80/", "x://a.net\n/en/", "http://a.net/" + "en/" * 30_000, "a://b://net/"]
    return rules, urls + urls[:40] + urls[:1] * 300


@pytest.mark.parametrize("most", [url_rules.MOST_RULES, 10])
def test_like_brute_force(spark, most):
    """By the trie, and by joins where the rules are too many for it."""
    rules, urls = invented()
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(df, spark.createDataFrame(rules, url_rules.RULES), keep=["page_id"], most_rules=most).collect()}
    assert got == {i: expected(u, rules) for i, u in enumerate(urls)}


def test_edges(spark):
    rules = spark.createDataFrame([("Net", "/", "block"), ("net", "/", "allow"), ("a.net", None, "allow")], url_rules.RULES)
    df = spark.createDataFrame([(None, "http://net/", "x", 1), (1, "http://b.a.net", "y", 2), (1, "http://b.a.net", "y", 2)], "page_id long, url string, verdict string, _host long")
    got = sorted(tuple(r) for r in url_rules.judge_urls(df, rules, otherwise="block").collect() if r["page_id"])
    assert got == [(1, "http://b.a.net", 2, "b.a.net", "", "a.net", "allow")] * 2
    assert url_rules.judge_urls(df, rules).where("page_id IS NULL").first()["verdict"] == "block"  # the blocking twin
    assert url_rules.judge_urls(df.limit(0), rules).count() == 0 and url_rules.judge_urls(df, rules.limit(0)).where("verdict = 'allow'").count() == 3
    for bad in (("", "/", "block"), (None, "/", "block"), ("net", "x", "allow"), ("net", "/", "maybe")):
        with pytest.raises(ValueError):
            url_rules.judge_urls(df, spark.createDataFrame([bad], url_rules.RULES))
