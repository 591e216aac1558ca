from __future__ import annotations

import re

from procura.llm import queries, urls

HARD = [
    None, "", "no scheme", "mailto:x", "http://", "http://net", "http://net/", "HTTP://WWW.Example.NET/en/x", "x://example.net/en?y", "http://EXAMPLE.com/de/1#a",
    "http://notexample.com/de/", "http://a.org/fr/", "http://a.org/FR/", "http://É.ORG/fr/é?q#z", "a://b://net/", "http://a\nb.net/\n?x", "http://example.net:80/en/", "://org/fr/",
    "http://casino-win.example.org/en/5", "http://adult-x.example.com/x", "http://www.library.example.com/en/5", "http://x.example.com/" + "ab/" * 20_000,
]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fit, default=(0, None, None))
    return host, path, rule, verdict


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(k, u, 0, "x") for k, u in enumerate(HARD)] + [(None, HARD[6], 1, "y"), (6, HARD[6], 1, "y")], "page_id long, url string, score int, host string")
    got = urls.judge(df).collect()
    assert len(got) == len(HARD) + 2
    for r in got:
        host, path, rule, verdict = parts(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and 0 <= r.score <= 1
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    by = {r.url: r.verdict for r in got}
    assert by[HARD[18]] == by[HARD[19]] == "block" and by[HARD[20]] == "allow"


def test_the_model_learns_its_table(spark):
    found = urls.judge(urls.labelled_urls(spark), rules=()).collect()
    assert sum((r.verdict == "block") == (r.label == 1) for r in found) >= 0.97 * len(found)
    none = urls.labelled_urls(spark).limit(0)
    assert {r.score for r in urls.judge(urls.labelled_urls(spark), none).collect()} == {0.0}


def test_no_python_in_the_plan(spark, folder):
    got = queries.op7_urls(spark, folder)
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD|Cartesian", plan)
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()}
    rows = got.collect()
    assert len(rows) == len(pages)
    assert all((r.host, r.path, r.rule) == parts(pages[r.page_id])[:3] and r.verdict in ("allow", "block") for r in rows)


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "url string")).collect() == []
