"""URL rules and the source mix."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wortlaut.llm.mixing import draw_mix, source_targets, take_mix
from wortlaut.llm.queries import URL_RULES
from wortlaut.llm.url_filter import judge_urls, rule_table


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    path = tail[:end]
    fits = [
        (len(h + p), len(h), a == "block", h + p, a)
        for a, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


URLS = [
    None, "", "no scheme", "://", "http://", "http://com/", "http://COM", "https://a.b.example.com/en/x?y#z",
    "https://www.example.com/en/", "https://WWW.Example.Com/en/a/b/c", "http://notexample.com/en/", "http://x.net/es/1",
    "http://net/fr/", "http://net/fr", "http://net/es//", "ftp://u@net:80/es/", "http://x.net?/es/", "http://x.net#/es/",
    "http://a://b.net/es/", "http://" + "a." * 3000 + "net/" + "es/" * 3000, "http://example.com/en", "http://é.net/fr/é",
    "HTTP://EXAMPLE.COM/EN/", "http://example.com//en/", "http://.net/es/", "http://net./es/", "http://a\nb.net/es/\n",
]


@pytest.mark.parametrize("prefix_bytes", [4, 1])
def test_rules_against_brute_force(spark, prefix_bytes):
    rules = [*URL_RULES, ("block", "org", "/a"), ("allow", "org", "/ab/c"), ("allow", "x.org", ""), ("block", "tie.org", "/"),
             ("allow", "tie.org", "/")]
    urls = URLS + ["http://org/abc", "http://org/ab/cd/e", "http://y.x.org", "http://y.x.org/a", "http://tie.org/", "http://org/"]
    rows = [(i, u, "html", "h") for i, u in enumerate(urls)] + [(3, URLS[3], "html", "h")] * 2 + [(None, URLS[8], "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = [tuple(r) for r in judge_urls(pages, rule_table(spark, rules), prefix_bytes=prefix_bytes).collect()]
    want = [(i, *judged(u, rules)) for i, u, *_ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_pages_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert judge_urls(pages.limit(0), rule_table(spark, URL_RULES)).count() == 0
    none = rule_table(spark, URL_RULES).limit(0)
    assert [tuple(r) for r in judge_urls(pages, none, default="block").collect()] == [(1, "a.com", "/", None, "block")]
    nulls = spark.createDataFrame([("block", None, "/"), (None, "com", "/"), ("block", "com", None)], "action string, host string, path string")
    assert judge_urls(pages, nulls).first().rule == "com"


def shared(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        open_ = sum(weight[s] for s in order if s not in stopped)
        target = {s: most * sizes[s] if s in stopped else rest * weight[s] / open_ for s in order}
        over = {s for s in order if s not in stopped and target[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        stopped |= over


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, None: 20, "é": 300}, {"only": 7}, {"a": 10, "b": 0, "c": 1, "d": 400}],
)
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(table).collect()}
    want = shared(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)
    assert math.isclose(sum(got.values()), sum(sizes.values()))


def words(n):
    return " ".join(["w"] * n)


def corpus(spark):
    random.seed(8)
    rows = []
    for i in range(1500):
        source = random.choice(["hot"] * 6 + ["a", "b", "c", None])
        rows.append((i, words(random.choice([0, 3, 40, 41, 200, 1000])), source, 1, 2.0, 3))
    rows += [(None, words(10), "a", 1, 2.0, 3), (5000, None, "b", 1, 2.0, 3), (5001, words(7), "c", 1, 2.0, 3)]
    rows += [(5001, words(7), "c", 1, 2.0, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target double, _copies int")


def test_mix_comes_near_its_targets_and_repeats(spark):
    docs = corpus(spark)
    rows = draw_mix(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        own = by.setdefault(r.source, [0, 0, r.source_size, r.target])
        own[0] += r["size"]
        own[1] += r.taken
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    assert {s: v[3] for s, v in by.items()} == pytest.approx(shared({s: v[0] for s, v in by.items()}))
    for size, taken, source_size, target in by.values():
        assert size == source_size and abs(taken - target) <= 2000
    again = draw_mix(docs.repartition(5)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mixed_documents(spark):
    docs = corpus(spark)
    drawn = {r.doc_id: r.copies for r in draw_mix(docs).filter("doc_id < 5000").collect()}
    mixed = take_mix(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert {k: n for k, n in drawn.items() if n} == {k: n for k, n in counts.items() if k is not None and k < 5000}
    without = draw_mix(docs).filter("doc_id is null").agg(F.sum("copies")).first()[0]
    assert counts.get(None, 0) == without > 0


def test_rows_without_a_key_are_drawn_like_others(spark):
    """Sources of 90 and 10 equally long texts, weighed 1 and 2: all keys null, then all keys equal."""
    for key in (None, 7):
        rows = [(key, f"w{i} a b", "a" if i < 90 else "b") for i in range(100)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        drawn = {r.source: r.words for r in draw_mix(docs).groupBy("source").agg(F.sum("taken").alias("words")).collect()}
        words = {r.source: 3 * r["count"] for r in take_mix(docs).groupBy("source").count().collect()}
        assert drawn == words and words["b"] == 90 and abs(words["a"] - 210) <= 3


def test_equal_rows_are_drawn_together_and_odd_names_stay(spark):
    rows = [(1, "same text here", "a", i) for i in range(6)] + [(None, "same text here", "a", 9)] * 3 + [(2, "x y z", "b", 0), (3, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int").withColumn("mark", F.lit(1)).withColumn("copies", F.lit(2))
    mixed = take_mix(docs)
    assert mixed.columns == docs.columns
    drawn = draw_mix(docs).groupBy("source").agg(F.sum("copies").alias("n")).filter("n > 0")
    assert {r.source: r.n for r in drawn.collect()} == {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}


def test_rule_hosts_are_lowered_like_page_hosts(spark):
    rules = [("block", "BÜCHER.de", "/"), ("block", "Example.ORG", "/")]
    pages = spark.createDataFrame([(1, "http://BÜCHER.de/x"), (2, "http://bücher.de/x"), (3, "http://EXAMPLE.org/")], "page_id long, url string")
    got = {r.page_id: (r.host, r.verdict) for r in judge_urls(pages, rule_table(spark, rules)).collect()}
    assert got == {1: ("bÜcher.de", "block"), 2: ("bücher.de", "allow"), 3: ("example.org", "block")}


def test_mix_of_nothing(spark):
    docs = corpus(spark)
    assert draw_mix(docs.limit(0)).count() == 0 and take_mix(docs.limit(0)).count() == 0
    silent = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in draw_mix(silent).collect()] == [(0.0, 0), (0.0, 0)]
