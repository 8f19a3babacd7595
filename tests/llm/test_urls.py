from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from reviewlytics.llm import urls

AZ = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_rule(url, rules=urls.RULES):
    """host, path, rule, verdict by plain string work."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(AZ)
    best = None
    for verdict, rule in rules:
        own, begin = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + begin):
            if best is None or (len(rule), rule.find("/")) > (len(best[0]), best[0].find("/")):
                best = (rule, verdict)
    return host, path, *(best or (None, None))


URLS = [
    "http://a.net/x", "http://a.net", "http://a.net?x=/", "http://net/", "http://xnet/", "https://A.Example.NET/en/5?q=1",
    "https://example.net/en", "https://example.net/en/", "http://www.example.com/de/1#top", "http://example.com/DE/1",
    "http://example.com.evil.org/de/1", "http://x.org/fr/2", "http://x.org/fr", "http://org/fr/", "ftp://b.net/a?u=http://c.org/fr/",
    "no scheme", "", None, "://", "http://", "http:///net/", "HTTP://ÀB.Net/É/%41?a&b=&&c#d?e", "http://a.net#/x", "http://a.net\n/x", "x://y://net/",
    "http://user@h.net:80/p/q//r?k=v&k2=v2", "http://a-b-c.example.com/de/%20%41", "http://" + "9" * 5000 + ".com/de/",
]


def test_rules(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[0])]
    df = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS rule", "'x' AS verdict", "3 AS score", "4 AS y")
    got = urls.judge(df.repartition(2)).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"]) for r in got if r["page_id"] is not None) == sorted(
        ((k, *plain_rule(u)[:3]) for k, u in rows if k is not None), key=lambda r: (r[0], r[1])
    )
    for r in got:
        ruled = plain_rule(dict(rows)[r["page_id"]])[3]
        assert r["verdict"] == (ruled or ("block" if r["score"] > 0.5 else "allow")) and 0 <= r["score"] <= 1
    assert len(got) == len(rows)


def test_longest_rule_wins(spark):
    rules = (("block", "a.b/c/"), ("allow", "b/c/de"), ("block", "b/"), ("allow", "x.a.b/c/d"))
    given = ["http://a.b/c/de", "http://b/c/de/", "http://x.a.b/c/d", "http://q.b/z", "http://a.b/c/d"]
    df = spark.createDataFrame(list(enumerate(given)), "page_id bigint, url string")
    got = {r["page_id"]: (r["rule"], r["ruled"]) for r in urls.with_rules(df, rules).collect()}
    assert got == {k: plain_rule(u, rules)[2:] for k, u in enumerate(given)}
    assert got[0] == ("a.b/c/", "block")  # as long as b/c/de, with the longer host


def entropy(text):
    classes = Counter(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else "" for c in text.lower())
    n = sum(classes.values())
    return round(-sum(v / n * math.log2(v / n) for v in classes.values()), 6) + 0.0 if n else 0.0


def plain_lexical(url):
    url = url or ""
    host, path, _, _ = plain_rule(url)
    found = re.match(r"[^?#]*\?([^#]*)", url)
    query = found.group(1) if found else ""
    share = lambda s: round(sum(c in "0123456789" for c in s) / len(s), 6) if s else 0.0
    labels = host.split(".")
    return [
        len(url), len(host), len(path), len(query), sum(s != "" for s in path.split("/")),
        sum(s != "" for s in query.split("&")), len(labels) if host else 0, host.count("-"), url.count("%"),
        sum("A" <= c <= "Z" for c in url), share(url), share(host), entropy(url), entropy(host),
        len(labels[-1]), len(".".join(labels[-2:])),
    ]


def test_lexical_features(spark):
    given = [u for u in URLS if u is None or "\n" not in u]
    df = spark.createDataFrame(list(enumerate(given)), "page_id bigint, url string")
    got = {r["page_id"]: [r[c] for c in urls.LEXICAL] for r in urls.lexical(df, "page_id").collect()}
    for k, u in enumerate(given):
        assert got[k] == pytest.approx(plain_lexical(u), abs=2e-6), u


def plain_boosting(x, y, start, trees, depth):
    """Least-squares splits of the logistic loss over binned columns, one row at a time."""
    cuts = [sorted(set(np.percentile(x[:, f], [100 * k / urls.BINS for k in range(1, urls.BINS)]).tolist())) for f in range(x.shape[1])]
    score = np.full(len(y), start)
    gain = lambda g, h: g * g / (h + urls.PENALTY)

    def grow(rows, g, h, level):
        best = (1e-9, None)
        for f in range(x.shape[1]):
            for cut in cuts[f]:
                right = x[rows, f] > cut
                if min(right.sum(), (~right).sum()) < urls.LEAST_ROWS:
                    continue
                a, b = rows[~right], rows[right]
                got = gain(g[a].sum(), h[a].sum()) + gain(g[b].sum(), h[b].sum()) - gain(g[rows].sum(), h[rows].sum())
                if got > best[0] + 1e-9:
                    best = (got, (a, b))
        if best[1] is None or level == depth:
            return [(rows, -urls.RATE * g[rows].sum() / (h[rows].sum() + urls.PENALTY))] if level else []
        return [leaf for part in best[1] for leaf in grow(part, g, h, level + 1)]

    for _ in range(trees):
        chance = 1 / (1 + np.exp(-score))
        new = score.copy()
        for rows, value in grow(np.arange(len(y)), chance - y, chance * (1 - chance), 0):
            new[rows] += value
        score = new
    return score


def spam(rng, k):
    bad = k % 3 == 0
    name = "".join(rng.choice("abcdefgh" + "0123456789" * bad) for _ in range(rng.randint(4, 9 + 9 * bad)))
    path = "/".join("x" * rng.randint(1, 6) for _ in range(rng.randint(0, 3)))
    query = "&".join(f"p{i}={rng.randint(0, 999)}" for i in range(rng.randint(0, 2 + 3 * bad)))
    top = rng.choice(["com", "org", "biz" if bad else "edu"])
    return f"http://{name}.{top}/{path}" + f"?{query}" * bool(query), int(bad)


def test_trees_against_plain_boosting(spark):
    rng = random.Random(4)
    rows = [(k, *spam(rng, k)) for k in range(400)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, y int").repartition(3)
    model = urls.fit(df, trees=4)
    got = model.features(df, "page_id", "y").withColumn("m", model.margin()).collect()
    got.sort(key=lambda r: r["page_id"])
    x = np.array([[r[c] for c in urls.FEATURES] for r in got])
    y = np.array([r["y"] for r in got], float)
    want = plain_boosting(x, y, model.base, 4, urls.DEPTH)
    assert np.abs(np.array([r["m"] for r in got]) - want).max() < 1e-4


def test_suffix_statistics(spark):
    given = [("http://a.b.com/", 1), ("http://c.com/", 0), ("http://b.com/", None), ("http://x.org/", 0), (None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(given)], "page_id bigint, url string, y int")
    model = urls.fit(df)
    got = {r["page_id"]: r for r in model.features(df, "page_id").collect()}
    rate = 1 / 3
    assert got[0]["suffix_share"] == got[1]["suffix_share"] == round(math.log2(4 / 6), 6)
    assert got[0]["suffix_blocked"] == round((1 + 20 * rate) / 22, 6) and got[3]["suffix_blocked"] == round(20 * rate / 21, 6)
    assert got[0]["domain_blocked"] == got[2]["domain_blocked"] == round((1 + 20 * rate) / 21, 6)
    assert got[1]["domain_share"] == round(math.log2(2 / 6), 6)


def test_held_out_accuracy_of_sampled_training(spark):
    rng = random.Random(6)
    rows = [(k, *spam(rng, k)) for k in range(3000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, y int")
    known, unknown = df.where("page_id % 2 = 0"), df.where("page_id % 2 = 1")
    got = urls.judge(unknown, rules=(), labelled=known, sample=700).collect()
    right = sum((r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in got)
    assert len(got) == 1500 and right / len(got) > 0.9


def test_one_label_no_label_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (2, None)], "page_id bigint, url string")
    assert [r["verdict"] for r in urls.judge(df).collect()] == ["allow", "allow"]
    one = spark.createDataFrame([(1, "http://a.net/"), (2, "http://a.com/")], "page_id bigint, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(one).collect()} == {1: "block", 2: "block"}
    assert urls.judge(df.where("false")).collect() == []


def test_plan_is_native(spark, plan_of):
    text = plan_of(urls.judge(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")))
    assert not re.search("Python|Arrow|Pandas|Exchange", text) and "ReadSchema: struct<page_id:bigint,url:string>" in text
