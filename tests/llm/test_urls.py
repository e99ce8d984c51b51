import re
from collections import Counter

from pyspark.sql import functions as F

from txflow.llm import urls
from txflow.llm.queries import GIVEN_RULES

URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/17?x=1#y", "http://example.org/en/2", "http://example.org", "http://org/", "http://notexample.org/es/",
    "http://x.com/fr/", "http://x.com/de/", "http://x.com/de", "http://com/de/1", "no scheme", "", None, "http://", "://h/p", "a://b://c/d", "http://h?q=/fr/",
    "http://x.com/fr/\nline", "http://x..com/fr/a.HTML?b&c=d&=e#", "http://ünï.com/de/ü", "http://x.com/fr/" + "p/" * 20_000,
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h), len(p), h + p) for h, p, _ in GIVEN_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None


def pages(spark):
    rows = [(i, u, "html", "h", "p", 1.0) for i, u in enumerate(URLS)] + [(0, URLS[0], None, None, None, None), (None, URLS[6], None, None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string, confidence double")


def test_given_rules_against_brute_force(spark):
    df = pages(spark)
    none = spark.createDataFrame([], "url string, bad boolean")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, none, GIVEN_RULES).collect())
    verdict = {h + p: v for h, p, v in GIVEN_RULES}
    want = Counter((r.page_id, *brute(r.url), verdict.get(brute(r.url)[2], "allow")) for r in df.collect())
    assert got == want


def labelled(spark):
    rows = [(f"http://spam-farm{i % 3}.net/win/{i}?ref=x", True) for i in range(200)]
    rows += [(f"http://good{i % 7}.net/win/{i}", False) for i in range(400)] + [(f"https://spam.good.net/a/{i}?ref=y", False) for i in range(150)]
    rows += [(None, True), ("http://x.net", None), ("http://good1.net/win/1", False)]
    return spark.createDataFrame(rows, "url string, bad boolean")


def tokens(df):
    return df.select(urls.tokens_of(F.col("url"), urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("tokens"), "bad")


def test_mined_rules_are_sure_frequent_and_minimal(spark):
    rows = [(set(r.tokens), r.bad) for r in tokens(labelled(spark)).collect() if r.bad is not None]
    rules = urls.mine(tokens(labelled(spark)), support=0.05, confidence=0.8).collect()
    assert rules
    for r in rules:
        met = [bad for t, bad in rows if set(r.tokens) <= t]
        assert abs(sum(met) / len(met) - r.confidence) < 1e-9 and r.confidence >= 0.8 and sum(met) >= 0.05 * len(rows)
        counts = {t: sum(t in x for x, _ in rows) for t in r.tokens}
        assert counts[r.key] == min(counts.values())
    sets = [set(r.tokens) for r in rules]
    assert not any(a < b and ra.confidence >= rb.confidence for a, ra in zip(sets, rules) for b, rb in zip(sets, rules))


def test_mined_rules_block_what_they_match(spark):
    new = [(1, "http://spam-farm1.net/win/999?ref=x"), (2, "http://good2.net/win/9"), (3, "http://other.org/win"), (4, "http://spam-farm9.org/x?ref=q")]
    df = spark.createDataFrame(new, "page_id long, url string")
    got = {r.page_id: (r.verdict, r.rule, r.mined_rule) for r in urls.judge(df, labelled(spark), GIVEN_RULES, support=0.05, confidence=0.8).collect()}
    assert got[1][0] == "block" and got[1][1] is None and got[1][2]
    assert got[2] == ("allow", None, None) and got[3][:2] == ("allow", "org/") and got[4][:2] == ("allow", "org/")


def test_single_tokens_against_brute_force_at_every_size(spark):
    urls_ = [(f"http://a{i}.bad-host.net/x/{i}", True) for i in range(9)] + [(f"http://ads.ok.net/x/{i}", i < 6) for i in range(7)]
    few = urls_ + [(f"http://good{i % 50}.org/y/{i}", i % 8 == 0) for i in range(400)]
    many = urls_ + [(f"http://good{i % 50}.org/y/{i}", i % 8 == 0) for i in range(12_000)]
    for given in (few, many):  # nine URLs are 2 % of the one table and less than 0.1 % of the other
        df = tokens(spark.createDataFrame(given, "url string, bad boolean"))
        rows = [(set(r.tokens), r.bad) for r in df.collect()]
        base = sum(bad for _, bad in rows) / len(rows)
        want = {}
        for t in set().union(*(x for x, _ in rows)):
            n, hits = sum(t in x for x, _ in rows), sum(t in x and bad for x, bad in rows)
            p, z = hits / n, 16
            bound = (p + z / (2 * n) - 4 * (p * (1 - p) / n + z / (4 * n * n)) ** 0.5) / (1 + z / n)
            if hits >= 8 and n < len(rows) and p >= 0.7 and bound >= 1.2 * base:
                want[t] = p
        got = {r.tokens[0]: r.confidence for r in urls.mine(df, support=0.05).collect() if len(r.tokens) == 1}
        assert got == want and "domain:bad-host.net" in got and not any("ok" in t for t in got)
    page = spark.createDataFrame([(1, "https://new.sub.bad-host.net/z"), (2, "https://goods.org/z")], "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in urls.judge(page, spark.createDataFrame(many, "url string, bad boolean"), GIVEN_RULES).collect()}
    assert verdicts == {1: "block", 2: "allow"}


def test_empty(spark):
    assert urls.judge(pages(spark).limit(0), labelled(spark), GIVEN_RULES).collect() == []
