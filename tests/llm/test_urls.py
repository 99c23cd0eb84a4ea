"""Rules, and the model ratio on URLs made by two different sources."""

import random

import pytest
from pyspark.sql import functions as F

from glyphrake.llm import urls
from glyphrake.llm.common import ship


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("HTTP://WWW.Example.COM/en/7x?q", "www.example.com", "/en/7x", "example.com/en/7", "allow"),
    ("http://other.com/en/7", "other.com", "/en/7", "com/en/", "block"),
    ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
    ("http://badexample.net/de/8", "badexample.net", "/de/8", "net/de/", "allow"),
    ("http://x.org#/es/", "x.org", "", None, None),
    ("http://x.org/es", "x.org", "/es", None, None),
    ("http://x.org/a://y.com/en/", "x.org", "/a://y.com/en/", None, None),
    ("x.com/en/", "", "", None, None),
    (None, "", "", None, None),
])
def test_rules(spark, url, host, path, rule, verdict):
    h, p = urls.host_and_path(F.col("url"))
    r, v = urls.matching_rule(F.col("h"), F.col("p"))
    row = spark.createDataFrame([(url,)], "url string").select(h.alias("h"), p.alias("p")).select("h", "p", r.alias("r"), v.alias("v")).first()
    assert tuple(row) == (host, path, rule, verdict)


def test_unruled_urls_follow_their_likeness(spark):
    ship(spark)
    drawn = random.Random(2)
    good = lambda: "".join(drawn.choice("aeiou") + drawn.choice("lmnr") for _ in range(5))
    bad = lambda: "".join(drawn.choice("xqzk") + drawn.choice("0123") for _ in range(5))
    rows = [(i, f"http://{good()}.net/de/{good()}") for i in range(300)] + [(i, f"http://{bad()}.org/es/{bad()}") for i in range(300, 600)]
    rows += [(i, f"http://{good()}.info/{good()}") for i in range(600, 650)] + [(i, f"http://{bad()}.info/{bad()}") for i in range(650, 700)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all((r.rule is None) == (i >= 600) for i, r in got.items())
    right = [got[i].verdict == ("allow" if i < 650 else "block") for i in range(600, 700)]
    assert sum(right) >= 95


def test_the_whole_url_is_scored(spark):
    """Unruled URLs that differ in query, fragment or scheme only, and some without ://."""
    ship(spark)
    drawn = random.Random(3)
    good = lambda: "".join(drawn.choice("aeiou") + drawn.choice("lmnr") for _ in range(5))
    bad = lambda: "".join(drawn.choice("xqzk") + drawn.choice("0123") for _ in range(5))
    rows = [(i, f"http://{k}.net/de/?{good()}={good()}") for i, k in enumerate("ab" * 150)] + [(300 + i, f"http://{k}.org/es/?{bad()}={bad()}") for i, k in enumerate("ab" * 150)]
    for i in range(30):
        rows += [(600 + 10 * i + k, f.format(x())) for k, (f, x) in enumerate((f, x) for f in ("http://a.info/?{0}={0}", "http://a.info/#{0}{0}", "{0}/{0}") for x in (good, bad))]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([*rows, (9_999, None)], "page_id long, url string")).collect()}
    right = [got[i].verdict == ("block" if i % 2 else "allow") for i, _ in rows[600:]]
    assert len(right) == 180 and sum(right) >= 170 and got[9_999].host == ""


def plain_scores(rows):
    """The models in dictionaries of real contexts: url -> score of (url, side or None) pairs."""
    import math

    counts = [{}, {}]
    for url, side in rows:
        if side is not None:
            padded = "\n" * 4 + url + "\n"
            for i in range(4, len(padded)):
                for k in range(5):
                    own = counts[side].setdefault(padded[i - k : i], {})
                    own[padded[i]] = own.get(padded[i], 0) + 1

    def probability(side, before, char):
        p = 1 / 256
        for k in range(5):
            own = counts[side].get(before[4 - k :])
            if own:
                n, kinds = sum(own.values()), len(own)
                p = (own.get(char, 0) + kinds * p) / (n + kinds)
        return p

    out = {}
    for url, _ in rows:
        padded = "\n" * 4 + url + "\n"
        logs = [math.log(probability(0, padded[i - 4 : i], padded[i])) - math.log(probability(1, padded[i - 4 : i], padded[i])) for i in range(4, len(padded))]
        out[url] = sum(logs) / len(logs)
    return out


@pytest.mark.parametrize("frequent", [0, 1 / 300, 2])
def test_scores_against_dictionaries(spark, frequent, monkeypatch):
    """With all, some and none of the grams sent to the tasks; grams of any alphabet keep apart."""
    ship(spark)
    monkeypatch.setattr(urls, "FREQUENT", frequent)
    drawn = random.Random(7)
    rows = [("".join(drawn.choice("abcé漢/.") for _ in range(drawn.randint(0, 25))), drawn.choice([0, 1, None])) for _ in range(120)]
    rows = list({u: (u, s) for u, s in rows}.values())
    rows += [rows[0]] * 3
    texts = spark.createDataFrame(rows, "text string, side int").groupBy("text", "side").agg(F.count("*").alias("times")).withColumn("key", F.md5("text"))
    got = urls.scores(texts, urls.gram_values(urls._counted(texts)))
    want = plain_scores(rows)
    found = {r.text: r.score for r in texts.join(got, "key").collect()}
    assert set(found) == set(want) and all(abs(found[u] - want[u]) < 1e-8 for u in want)


def test_the_bound_splits_what_it_has_seen(spark):
    rows = [(0, 0.5, 3), (0, 0.1, 1), (1, -0.2, 2), (1, -0.9, 5)]
    bound = urls.calibrated(spark.createDataFrame(rows, "side int, score double, times long"))
    assert -0.2 < bound <= 0.1
    assert urls.calibrated(spark.createDataFrame(rows[:2], "side int, score double, times long")) == 0.0
