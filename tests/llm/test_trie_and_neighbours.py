"""Fill-in-the-middle, the trie of conversations and nearest neighbours against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wortlaut.llm.fill_in_middle import fill_in_middle, line_widths, restore
from wortlaut.llm.hash_forest import HashFamily, HashForest
from wortlaut.llm.neighbours import nearest
from wortlaut.llm.prefix_trie import prefix_trie
from wortlaut.llm.skip_list import SkipList

EMPTY = hashlib.sha256(b"").hexdigest()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# Fill-in-the-middle


@pytest.mark.parametrize("fan", [2, 3, 16])
@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 256, 1000])
def test_every_rank_of_a_skip_list(n, fan):
    widths = [random.Random(n * fan + i).randrange(1, 50) for i in range(n)]
    units = SkipList(widths, fan)
    assert len(units) == n
    assert [units.place(r) for r in range(n + 1)] == [sum(widths[:r]) for r in range(n + 1)]
    assert all(len(skipped) == len(chars) for skipped, chars in units.lanes)
    with pytest.raises(IndexError):
        units.place(n + 1)


def test_units_are_lines():
    for text in ("", "a", "a\n", "\n", "\n\n", "a\nb", "a\n\nb\n", "a\r\nb\x0bc\x85d e\n", "ä\n😀\n日本"):
        assert line_widths(text) == [len(u) for u in re.findall(r"[^\n]*\n|[^\n]+", text)]


def arranged(key, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return key, len(units), "plain", None, None, text, text
    if h[3] % 100 < spm:
        return key, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return key, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


LINES = [
    None, "", "one line", "a\nb\nc", "\n\n\n", "x <S> y\nz", "a<\nS>b\n<P", "<", "<<S\n>>\nM>", "ä\n😀😀\r\n\n日本 text\x85\n",
    "".join(f"line {i} é\n" for i in range(30_000)), "w" * 300_000, "tail\nwithout end",
]


@pytest.mark.parametrize("rate, spm", [(100, 50), (50, 0), (100, 100), (0, 50)])
def test_fill_in_middle(spark, rate, spm):
    rows = [(i, t) for i, t in enumerate(LINES * 5)] + [(None, "no\nkey"), (3, "a key\nagain\n"), (3, "a key\nagain\n"), (-4, "x\ny")]
    wide = [(k, t, "x", 1, "o", "t") for k, t in rows]
    docs = spark.createDataFrame(wide, "doc_id long, text string, output string, n int, `a.b` string, drawn_by string")
    found = fill_in_middle(docs, rate=rate, spm_rate=spm)
    found = found.withColumn("restored", restore(F.col("output"), F.col("form")))
    got = [tuple(r) for r in found.collect()]
    want = [arranged(k, t, rate=rate, spm=spm) for k, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert rate == 0 or {r[2] for r in got} >= {"plain", "spm" if spm else "psm"}




def test_fill_in_middle_of_nothing(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_markers_that_cannot_be_told_apart_are_refused(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    for markers in (("", "<S>", "<M>"), ("<P<", "<S>", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, markers=markers)


# The trie of conversations


def trie(rows, group=20, openings=4):
    """Rows (conv_id, turn, role, text) by plain loops."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % openings
        base = c - (abs(c) % group if c >= 0 else -(abs(c) % group))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    nodes = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(built[c]) == len(path)))
        nodes.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
            sum(len(p) == len(path) + 1 for p in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return nodes


def conversations(spark, rows):
    wide = [(*r, "x", 5, "p", 1) for r in rows]
    names = "conv_id long, turn long, role string, text string, digest string, depth int, `a.b` string, rep int"
    return spark.createDataFrame(wide, names)


def check_trie(spark, rows, **options):
    band = options.pop("band", 16)
    got = [tuple(r) for r in prefix_trie(conversations(spark, rows), band=band, **options).collect()]
    assert sorted(got, key=repr) == sorted(trie(rows, **options), key=repr)


@pytest.mark.parametrize("band", [2, 3, 16])
def test_trie_of_random_conversations(spark, band):
    rng = random.Random(band)
    rows = [
        (c, t, rng.choice(["user", "system"]), rng.choice(["a b", "c", "", "d\te f"]))
        for c in [*range(60), 85, 99, 140, -3, -20, 2**40]
        for t in range(rng.choice([1, 2, 3, 6, 11]))
    ]
    check_trie(spark, rows, band=band)


def test_trie_with_nulls_ties_and_repeated_rows(spark):
    rows = [
        (0, None, "user", "hi"), (0, 1, None, "a b c"), (0, 1, None, "a b c"), (0, 1, "user", None), (0, None, "user", "hi"),
        (1, 5, "user", "x"), (2, 1, None, None), (2, 1, "", ""), (None, 1, "user", "lost"), (21, 1, "user", "y"), (22, 0, "1:", "a"),
        (22, 0, "1", ":a"), (40, 1, "u", "one two " * 20_000), (41, 1, "u", "one two " * 20_000), (42, 1, "u", "z"), (43, 1, "u", "z"),
    ]
    check_trie(spark, rows, band=2)
    check_trie(spark, rows, openings=1)


def test_trie_of_one_very_long_conversation_and_many_equal_ones(spark):
    rows = [(20, t, "user", f"w{t % 7}") for t in range(150)] + [(21, t, "user", f"w{t % 7}") for t in range(140)]
    rows += [(c, t, "user", "same text") for c in range(100, 180) for t in range(2)] + [(300, 1, "user", "again")] * 70
    check_trie(spark, rows, band=3)
    check_trie(spark, rows)


def test_trie_of_nothing(spark):
    assert prefix_trie(conversations(spark, [])).collect() == []
    assert prefix_trie(conversations(spark, [(None, 1, "user", "a")])).collect() == []


# Nearest neighbours


def exact(queries, vectors, k):
    best = {}
    for q, a in queries:
        for v, b in vectors:
            if q != v and len(a) == len(b):
                s = float(np.dot(np.array(a, float), np.array(b, float)))
                best[q, v] = max(s, best.get((q, v), -np.inf))
    found = defaultdict(list)
    for (q, v), s in best.items():
        found[q].append((-s, v))
    return {q: [(v, -s) for s, v in sorted(x)[:k]] for q, x in found.items()}


def found_by(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return dict(out)


def recall(got, want):
    return sum(len({v for v, _ in got[q]} & {v for v, _ in near}) for q, near in want.items()) / sum(map(len, want.values()))


def table(spark, rows, kind="float"):
    wide = [(k, v, 1, 2, "x") for k, v in rows]
    return spark.createDataFrame(wide, f"vec_id long, embedding array<{kind}>, cls int, block int, `a.b` string")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_recall_on_the_given_vectors(spark):
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = found_by(nearest(vectors.filter("vec_id % 20 = 0"), vectors, block_rows=100).collect())
    want = exact([r for r in rows if r[0] % 20 == 0], rows, 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    scores = {(q, v): s for q, near in exact(rows[::20], rows, len(rows)).items() for v, s in near}
    for q, near in got.items():
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(scores[q, v], rel=1e-12, abs=1e-15) for v, s in near)


def test_recall_with_lengths_clusters_and_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 24))
    rows = [(i, (centres[i % 30] + rng.standard_normal(24) * (0.001 if i % 3 else 0.5)) * 2.0 ** (i % 9 - 4)) for i in range(3000)]
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in rows]
    vectors = table(spark, rows)
    got = found_by(nearest(vectors.filter("vec_id % 50 = 0"), vectors, k=10, block_rows=300).collect())
    want = exact([r for r in rows if r[0] % 50 == 0], rows, 10)
    assert recall(got, want) >= 0.9


def test_equal_vectors_ties_and_odd_rows(spark):
    """All within what the forest reads whole: less than k candidates per query, or one class."""
    rows = [(i, [1.0, 2.0]) for i in range(60, 10, -1)] + [(100, [2.0, 4.0]), (100, [2.0, 4.0]), (5, [0.0, -1.0])]
    odd = [
        (None, [9.0, 9.0]), (200, None), (201, []), (202, [0.0, -0.0]), (203, [1.0, None]), (204, [float("nan"), 1.0]),
        (205, [float("inf"), 1.0]), (206, [1.0, 2.0, 3.0]), (207, [1.0, 2.0, 3.0]), (208, [7.0]),
    ]
    twice = [(300, [0.5, 0.5]), (300, [50.0, 0.0])]
    for kind in ("float", "double"):
        vectors = table(spark, rows + odd + twice, kind)
        for block_rows in (2, 1000):
            got = found_by(nearest(vectors, vectors, k=20, block_rows=block_rows).collect())
            usable = rows + odd[-3:] + twice
            assert got == exact(usable, usable, 20)


def test_nothing_to_search(spark):
    some, none = table(spark, [(1, [1.0])]), table(spark, [])
    assert nearest(none, none).collect() == [] and nearest(some, none).collect() == [] and nearest(none, some).collect() == []
    assert nearest(some, some).collect() == []


def test_prefixes_of_a_tree_are_ranges():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((500, 8))
    forest = HashForest(vectors, HashFamily(8, trees=4, bits=12, pool=64, seed=3))
    strings = forest.family.strings(rng.standard_normal((20, 8)))
    for level in (0, 1, 5, 12):
        marks = forest._reached(strings, np.full((4, 20), level))
        for q in range(20):
            agree = [(forest.sorted[t] >> np.uint64(12 - level)) == (strings[t, q] >> np.uint64(12 - level)) for t in range(4)]
            want = {int(v) for t in range(4) for v in forest.order[t][agree[t]]}
            assert set(np.flatnonzero(marks[q])) == want
    assert (forest.descend(strings, 50, 30).sum(axis=1) >= 30).all()
    assert forest.ascend(strings, np.ones(20), np.full(20, np.nan), 0.9).all()
