"""Rules against trying each one, held-out accuracy of the model, odd urls."""

import random
import re

import numpy as np

from feedfold.llm import catalog, urls


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


ODD = [None, "", "x", "://", "http://", "HTTP://WWW.Example.COM/EN/7", "http://example.com/en/7", "http://EXAMPLE.com/en/7?x#y",
       "http://a.com?x=/en/", "http://a.com#/en/", "http://com/en/", "http://notcom/en/", "http://a.com./en/", "a://b://c.com/en/",
       "http://É.com/en/é", "http://a.example.net/de/81", "http://example.net/de/7", "ftp://x.org/es/\n/z", "http://x.org/es",
       "http://" + "long." * 20_000 + "net/de/" + "p" * 50_000]


def test_rules_and_parts():
    rnd, rules = random.Random(1), urls.Rules(catalog.URL_RULES)
    hosts = ["com", "example.com", "a.example.com", "net", "example.net", "x.org", "bexample.net", "a.b"]
    made = [f"http://{rnd.choice(hosts)}{rnd.choice(['/en/', '/de/', '/es/', '/'])}{rnd.randrange(100)}" for _ in range(500)]
    for url in made + ODD:
        assert (*urls.parts(url), *rules.find(*urls.parts(url))) == brute(url, catalog.URL_RULES)
    two = urls.Rules([("allow", "b.c", "/d"), ("block", "c", "/d/e"), ("block", "a.b.c", "/")])
    assert two.find("a.b.c", "/d/e") == ("a.b.c/", "block") and two.find("b.c", "/d/e") == ("c/d/e", "block")


def test_table(spark):
    rows = [(i, u, "<p>", None) for i, u in enumerate(ODD)] + [(None, "http://x.org/es/1", None, 1), (7, ODD[7], "<p>", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, score int")
    model = urls.train(*urls.labelled_by_rules(pages, catalog.URL_RULES))
    got = urls.judged(pages, catalog.URL_RULES, model).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(r.rest.url, catalog.URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    none = pages.where("false")
    assert urls.train(*urls.labelled_by_rules(none, catalog.URL_RULES))["bias"] < 0
    assert urls.judged(none, catalog.URL_RULES, model).count() == 0


def test_held_out_accuracy(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    held = pages.where("page_id % 5 = 0")
    model = urls.train(*urls.labelled_by_rules(pages.where("page_id % 5 > 0"), catalog.URL_RULES))
    got = urls.judged(held, catalog.URL_RULES, model).where("rule is not null").select("verdict", "score").collect()
    right = [(r.verdict == "block") == (r.score >= 0.5) for r in got]
    assert len(right) > 100 and np.mean(right) > 0.95


def test_training_is_repeatable_and_bounded(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    a = urls.labelled_by_rules(pages, catalog.URL_RULES, most=50)
    assert a == urls.labelled_by_rules(pages.repartition(7), catalog.URL_RULES, most=50) and len(a[0]) == 50
    assert (urls.train(*a)["weights"] == urls.train(*a)["weights"]).all()
