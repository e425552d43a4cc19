import re

import pytest

from cohortlens.llm.queries import URL_RULES, op8_url_filter
from cohortlens.llm.urls import fit, judge, train

RULES = URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def rule(host, path):
    fits = []
    for r, verdict in RULES:
        h, slash, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(r), r, verdict))
    return max(fits)[1:] if fits else (None, None)


def check(rows, urls):
    assert len(rows) == len(urls)
    by = sorted(urls, key=str)
    for r, (i, url) in zip(sorted(rows, key=lambda r: str((r["page_id"], r["url"] if "url" in r else ""))), by):
        host, path = parts(url)
        name, verdict = rule(host, path)
        assert (r["page_id"], r["host"], r["path"], r["rule"]) == (i, host, path, name)
        assert r["verdict"] == (verdict or ("block" if r["score"] > 0.5 else "allow"))


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    urls = [tuple(r) for r in spark.read.parquet(f"{path}/pages.parquet").select("page_id", "url").collect()]
    rows = op8_url_filter(spark, path).collect()
    check(rows, urls)
    free = {r["host"]: r["verdict"] for r in rows if r["rule"] is None}
    assert free and sum(v == "allow" for v in free.values()) > len(free) / 2


ODD = [None, "", "no scheme", "http://", "https://A.B.Example.ORG/es/x?y#z", "http://example.org/en/1", "http://example.org/en/12/3",
       "http://example.org/en/2", "http://x.org", "http://org/", "http://xorg/", "ftp://a.com/de/", "http://ÄÖ.com/fr/é", "://com/de/x", "a://b://c/d",
       "http://h?q=/com/de/", "http://h#f", "http://user@Host:80/p", "http://x.com/de", "http://x.org\n/es/\nz", "http://" + "a" * 5000 + ".com/" + "b" * 5000]


def test_odd_urls(spark, tmp_path):
    rows = [(k, u, "extra", "extra") for k, u in enumerate(ODD)]
    spark.createDataFrame(rows, "page_id long, url string, host string, rule string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op8_url_filter(spark, str(tmp_path))
    check(got.collect(), [r[:2] for r in rows])


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "http://a.com/de/", "mine", "x")] * 3 + [(None, None, None, None)], "page_id long, url string, verdict string, other string")
    got = judge(df, RULES, train([]))
    assert sorted(got.columns) == sorted(["page_id", "url", "other", "host", "path", "rule", "verdict", "score"])
    assert [r["verdict"] for r in got.orderBy("url").collect()] == ["allow", "block", "block", "block"]
    assert judge(df.limit(0), RULES, train([])).count() == 0


def test_longest_rule_wins_whatever_the_order(spark):
    df = spark.createDataFrame([(1, "http://a.example.org/es/1")], "page_id long, url string")
    for rules in (RULES, RULES[::-1]):
        assert judge(df, rules, train([])).first()["rule"] == "example.org/es/"


def test_held_out_urls(spark):
    weights = fit(spark)
    urls = [("https://www.casino-royal.test/slots", "block"), ("http://pills-cheap.test/en/3", "block"), ("https://adult-cams.test/xxx", "block"),
            ("https://spam-farm.test/4", "block"), ("https://free-bets.test/odds", "block"), ("https://ads-track.test/click", "block"),
            ("https://library.test/history/books", "allow"), ("https://www.university-press.test/science/journal", "allow"),
            ("https://blog.cooking.test/recipes/soup", "allow"), ("https://docs.python-guide.test/reference/strings", "allow"),
            ("https://news.daily.test/world/article", "allow"), ("https://museum.test/art/collection", "allow")]
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in judge(df, [], weights).collect()}
    assert sum(got[k] == want for k, (_, want) in enumerate(urls)) >= 11


def test_own_labelled_table(spark):
    labelled = spark.createDataFrame([(f"http://good{i}.test/a", 0) for i in range(20)] + [(f"http://evil{i}.test/a", 1) for i in range(20)]
                                     + [(None, 1), ("http://x", None)], "url string, blocked int")
    w = fit(spark, labelled)
    df = spark.createDataFrame([(1, "http://good99.test/a"), (2, "http://evil99.test/a")], "page_id long, url string")
    assert [r["verdict"] for r in judge(df, [], w).orderBy("page_id").collect()] == ["allow", "block"]
    assert train([]) is not None and pytest.approx(0) == abs(train([])).max()
