from pyspark.sql import functions as F

from hazegrid.llm import urlfilter
from hazegrid.llm.queries import URL_RULES

CASES = [("https://WWW.Example.com/en/a?x#y", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
         ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
         ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
         ("http://a.net/es/", "a.net", "/es/", "net/es/", "block"), ("http://net/fr/x", "net", "/fr/x", "net/fr/", "block"),
         ("http://a.net", "a.net", "", None, "allow"), ("http://example.com?q=/en/", "example.com", "", None, "allow"),
         ("http://example.com#f", "example.com", "", None, "allow"), ("ÄB://Ü.ORG:80/p", "Ü.org:80", "/p", None, "allow"),
         ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://", "", "", None, "allow")]


def judged(spark, pages, labels):
    p = spark.createDataFrame(pages, "page_id long, url string, host string, bad int")
    return urlfilter.judge_urls(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), URL_RULES)


def test_hosts_paths_and_rules(spark):
    out = judged(spark, [(i, c[0], "h", 1) for i, c in enumerate(CASES)] + [(None, "http://x.org/", "h", 1)], [(999, 1, 0)]).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert {i: got[i] for i in range(len(CASES))} == {i: c[1:] for i, c in enumerate(CASES)} and len(out) == len(CASES) + 1


def test_bad_hosts_are_blocked_and_unknown_ones_inherit(spark):
    pages, labels = [], []
    for i in range(600):
        site = ("bad.spam.org", "fine.good.org", "x.mixed.org")[i % 3]
        pages.append((i, f"http://{site}/{i}", "h", 0))
        labels.append((i, 1, int(i % 3 == 0 or i % 3 == 2 and i % 2)))
    pages += [(1000, "http://new.spam.org/", "h", 0), (1001, "http://new.good.org/", "h", 0), (1002, "http://lone.org/", "h", 0)]
    out = {r.page_id: r for r in judged(spark, pages, labels + [(0, 0, None), (1, None, None)]).collect()}
    assert out[0].verdict == "block" and out[1].verdict == "allow"
    assert out[1000].rate > out[1002].rate > out[1001].rate  # shrunk to their domains
    assert out[0].lower_bound < out[0].rate
    assert out[1002].verdict == "allow"


def test_domains():
    assert "co.uk" in urlfilter.DOUBLE_SUFFIXES


def test_domain_and_suffix(spark):
    hosts = [("a.b.co.uk", "b.co.uk", "co.uk"), ("b.com", "b.com", "com"), ("com", "com", "com"), ("u@x.y.org:8080", "y.org", "org"), ("10.0.0.1:80", "10.0.0.1", ""), ("", "", "")]
    d, s = urlfilter.domain_and_suffix(F.col("h"))
    rows = spark.createDataFrame(hosts, "h string, d string, s string").select("d", "s", d.alias("gd"), s.alias("gs")).collect()
    assert all((r.d, r.s) == (r.gd, r.gs) for r in rows)


def test_empty(spark):
    assert judged(spark, [], [(1, 1, 1)]).count() == 0
    assert judged(spark, [(1, "http://a.org/", "h", 0)], []).first().verdict == "allow"
