"""Exact copies, near copies and components against brute force."""

import hashlib
import random
import re
import string

import numpy as np
import pytest
import xxhash

from wortlaut.llm import golay
from wortlaut.llm.components import connected
from wortlaut.llm.exact_dedup import drop_copies, mark_copies
from wortlaut.llm.simhash import drop_near_copies, fingerprint, near_groups, near_prints

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ROWS = [
    (1, "Some text"), (2, "some TEXT"), (3, "some text "), (4, "Äther"), (5, "äther"), (6, None), (7, ""), (8, "x" * 200_000),
    (9, "X" * 200_000), (10, "once"), (2, "some TEXT"), (None, "some text"), (None, "alone"), (11, "a"), (12, "A"),
]


def table(spark, rows):
    """With columns whose names the operators use themselves."""
    wide = [(k, t, "x", 1, "y", 2) for k, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, content string, keep_id int, digest string, salt int")


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_equal_texts(spark, digest_bytes):
    """With digests of one byte, many texts clash and only the content tells them apart."""
    rows = ROWS + [(100 + i, f"text {i % 400}") for i in range(900)]
    groups = {}
    for k, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(k)
    want = []
    for k, t in rows:
        norm = (t or "").translate(LOWER)
        keep = max((x for x in groups[norm] if x is not None), default=None)
        want.append((k, keep, len(groups[norm]), k == keep or keep is None, hashlib.sha256(norm.encode()).hexdigest()))
    got = [tuple(r) for r in mark_copies(table(spark, rows), digest_bytes=digest_bytes).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_dropping_keeps_columns_and_rows_without_a_key(spark):
    docs = table(spark, ROWS)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    keys = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert keys == [-1, -1, 2, 2, 3, 4, 5, 7, 9, 10, 12]


def kept_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_a_key_that_is_not_unique_keeps_its_other_texts(spark):
    rows = [(5, "a"), (5, "b"), (9, "a"), (7, "c"), (7, "c"), (7, "C"), (3, "c"), (None, "d"), (None, "d"), (None, "a")]
    docs = table(spark, rows)
    without = [(None, "a"), (None, "d"), (None, "d")]
    assert kept_rows(drop_copies(docs)) == sorted([(5, "b"), (7, "C"), (7, "c"), (7, "c"), (9, "a"), *without], key=repr)
    once = kept_rows(drop_copies(docs, repeats=False))
    assert [(k, t.lower()) for k, t in once] == sorted([(5, "b"), (7, "c"), (9, "a"), *without], key=repr)
    assert drop_copies(docs, repeats=False).columns == docs.columns


def test_near_copies_of_a_key_that_is_not_unique(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(2000)) for x in "abc")
    near = a.replace("a1000 ", "z ")
    assert 0 < (plain_print(a) ^ plain_print(near)).bit_count() <= 3
    rows = [(1, a), (5, a), (5, b), (6, b), (2, c), (2, c), (8, near), (1, near), (None, c), (None, c)]
    got = kept_rows(drop_near_copies(table(spark, rows)))
    assert [(k, t[0]) for k, t in got] == sorted([(1, "a"), (2, "c"), (5, "b"), (None, "c"), (None, "c")], key=repr)


def test_a_hot_text_meets_in_several_tasks(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) AS text").repartition(7)
    hot = [r for r in mark_copies(docs).collect() if r.group_size == 1000]
    assert len(hot) == 1000 and {r.keep_id for r in hot} == {2997} and sum(r.kept for r in hot) == 1


def test_empty_tables(spark):
    docs = table(spark, ROWS).limit(0)
    assert mark_copies(docs).count() == 0 and drop_copies(docs).count() == 0
    assert near_groups(docs).count() == 0 and drop_near_copies(docs).count() == 0


# near copies


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


@pytest.mark.parametrize(
    "text", [None, "", " \n", "one", "one two", "One  two\tthree", "a b c d a b c d", "é\u00a0x\x1cy Ä ß", "w " * 70_000]
)
def test_fingerprint(text):
    assert fingerprint(text) % 2**64 == plain_print(text)


def test_every_word_is_within_three_bits_of_its_codeword():
    table = golay.nearest()
    codeword = np.zeros(1 << 12, np.int64)
    zero_rest = np.flatnonzero(np.bincount(table, minlength=1 << 12) != 2048)
    assert not len(zero_rest)  # spheres of 1 + 23 + 253 + 1771 words
    words = np.arange(1 << 23)
    for index in (0, 1, 77, 4095):
        members = words[table == index]
        center = [m for m in members if (np.bitwise_count(members ^ m) <= 3).all()]
        assert len(center) == 1
        codeword[index] = center[0]
    assert codeword[0] == 0


def test_words_one_bit_apart_share_an_index():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 21, 3000)
    others = words ^ (1 << rng.integers(0, 21, 3000))
    near = golay.nearby(words, 21)
    assert (near == golay.nearest()[others][:, None]).any(axis=1).all()
    assert (near >= 0).sum(axis=1).max() <= 6


def flipped(x, bits):
    for b in bits:
        x ^= 1 << b
    return x


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_all_pairs_within_three_bits_are_found_once(spark):
    random.seed(11)
    prints = {0, 2**64 - 1}
    for _ in range(150):
        x = random.getrandbits(64)
        prints.add(x)
        for n in (1, 2, 3, 3, 3, 4):
            prints.add(flipped(x, random.sample(range(64), n)))
    for low, high in ((0, 22), (22, 43), (43, 64)):  # all errors in one segment, and one in each
        x = random.getrandbits(64)
        prints |= {x, flipped(x, random.sample(range(low, high), 3)), flipped(x, [0, 30, 63]), flipped(x, [20, 22, 43])}
    values = sorted(signed(x) for x in prints)
    want = {
        (a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3
    }
    got = near_prints(spark.createDataFrame([(v,) for v in values], "print long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_groups_against_brute_force(spark):
    random.seed(2)
    vocabulary = ["".join(random.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, key = [(900, None), (901, ""), (902, " "), (903, "one"), (904, "ONE"), (903, "one"), (None, "one")], 0
    for _ in range(25):
        words = random.choices(vocabulary, k=200)
        for _ in range(5):
            rows.append((key, " ".join(words)))
            key += 1
            words = list(words)
            words[random.randrange(200)] = random.choice(vocabulary)
    prints = [plain_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(k for (k, _), h in zip(rows, group, strict=True) if h == g and k is not None) for g in group}
    want = [(k, f"{p:016x}", least[g]) for (k, _), p, g in zip(rows, prints, group, strict=True)]
    got = [tuple(r) for r in near_groups(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(set(group)) < 120  # some did link
    kept = drop_near_copies(table(spark, rows)).filter("doc_id IS NOT NULL").select("doc_id").distinct().collect()
    assert {r.doc_id for r in kept} == set(least.values())


def test_components(spark):
    random.seed(4)
    chain = [(i, i + 1) for i in range(300)]
    random.shuffle(chain)
    star = [(1000, 1000 + i) for i in range(1, 200)]
    links = chain + star + [(5000, 4000), (5000, 4000), (6, 6), (None, 3), (7000, None)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = dict.fromkeys(range(301), 0) | dict.fromkeys(range(1000, 1200), 1000) | {4000: 4000, 5000: 4000}
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
