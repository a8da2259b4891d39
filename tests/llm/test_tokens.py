"""Encoding, the token store and packing."""

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from wortlaut.llm.encode import Encoder  # noqa: E402
from wortlaut.llm.packing import pack, plan_sequences  # noqa: E402
from wortlaut.llm.perfect_hash import PerfectHash  # noqa: E402
from wortlaut.llm.shared import scratch_path  # noqa: E402
from wortlaut.llm.token_store import TokenStore  # noqa: E402

BYTES, WORDS = (str(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    None, "", " ", "  a  b", "a\n b \tc", "don't  stop 's", " lead", "x  y z w ́q", "\x1c a b \x85 c .\x1c \x1f.",
    "word 'll go\n\n  end ", "ΑΣ ΟΔΟΣ Σ.", "é é é ́", "a" * 5000, "a\u00a0  b\u3000 c", "x.\u0301 y, z...' it's?'s a'll",
    "tail \x01 \x01 x", "mark \x02 inside", "1.2,3 $5 %%% a$$$ b.5 “.” a“.", "many words, " * 3000, "日本語 テキスト。 다음 문장!",
    "İstanbul ẞ ﬁ Ǆ", "\ufeffbom", "😀 👩‍👩‍👧 x",
]
ROWS = [(i * 7 % 23, t, i, -1, "k") for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, piece int, length long, key string"


def whole(path, texts, end):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return [e.ids + [end] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def checksum(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_give_the_ids_of_whole_texts(path):
    random.seed(1)
    alphabet = [" ", "\n", "  ", ".", ",", "'s", "a", "B", "é", "1", "\u00a0", "-", "\t", "'", "́", "word", "\x1c", "“"]
    texts = TEXTS + ["".join(random.choices(alphabet, k=40)) for _ in range(2000)]
    encoder = Encoder(path)
    assert [x.tolist() for x in encoder.encode(texts)] == [ids[:-1] for ids in whole(path, texts, 0)]
    assert [x.tolist() for x in encoder.encode(texts[:50])] == [ids[:-1] for ids in whole(path, texts[:50], 0)]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).permutation(10 * n + 10)[:n].astype(np.uint64)
    hashed = PerfectHash.build(keys)
    assert sorted(hashed.number(keys).tolist()) == list(range(n))
    again = PerfectHash.of(hashed.sizes, hashed.bits)
    assert (again.number(keys) == hashed.number(keys)).all()
    assert len(hashed.bits) * 64 <= 5 * n + 64 * 64


@pytest.mark.parametrize("shard_ids", [8_000_000, 40])
def test_store_round_trip(spark, shard_ids):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    rows = sorted(((k, t) for k, t, *_ in ROWS))
    want, at = {}, 0
    for (key, _), ids in zip(rows, whole(BYTES, [t for _, t in rows], 2), strict=True):
        want[key] = (at, len(ids), checksum(ids), ids)
        at += len(ids)
    store = TokenStore.write(docs, scratch_path(spark, "tokens"), BYTES, 2, shard_ids=shard_ids)
    got = store.summary().collect()
    assert {r.key: (r.start, r.n_tokens, r.ids_crc32) for r in got} == {k: v[:3] for k, v in want.items()}
    asked = spark.createDataFrame([(0,), (5,), (22,), (23,), (-1,), (10**12,), (None,), (5,)], "doc_id long")
    found = store.fetch(asked).collect()
    assert len(found) == 3 and {r.key: r.ids for r in found} == {k: want[k][3] for k in (0, 5, 22)}


def test_store_of_repeated_and_missing_keys(spark):
    rows = [(None, "no key"), (1, "b"), (1, "a"), (1, "a"), (None, None), (2, "x")]
    store = TokenStore.write(spark.createDataFrame(rows, "doc_id long, text string"), scratch_path(spark, "tokens"), BYTES, 2)
    got = sorted((r.start, r.key, r.n_tokens) for r in store.summary().collect())
    assert [k for _, k, _ in got] == [None, None, 1, 1, 1, 2]
    assert [s for s, _, _ in got] == [0, 1, 4, 6, 8, 10]
    empty = TokenStore.write(spark.createDataFrame([], "doc_id long, text string"), scratch_path(spark, "tokens"), BYTES, 2)
    assert empty.summary().count() == 0
    assert empty.fetch(spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def filled(runs):
    out = {}
    for length, _, n, sequence, offset in runs:
        for i in range(n):
            out.setdefault(sequence + i, []).append((offset, length))
    return out


@pytest.mark.parametrize("capacity", [1, 7, 100, 4096])
def test_plan_places_every_piece_once(capacity):
    rng = np.random.default_rng(capacity)
    for n in (0, 1, 30, 4000):
        lengths = np.minimum(capacity, rng.lognormal(np.log(capacity) - 2, 1, n).astype(int) + 1)
        counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        runs, sequences = plan_sequences(counts, capacity)
        numbers = {}
        for length, first, count, *_ in runs:
            numbers.setdefault(length, []).extend(range(first, first + count))
        assert {k: sorted(v) for k, v in numbers.items()} == {k: list(range(v)) for k, v in counts.items()}
        bins = filled(runs)
        assert sorted(bins) == list(range(sequences))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        bound = -(-int(lengths.sum()) // capacity)
        assert sequences <= max(bound + 1, 1.03 * bound)


@pytest.mark.parametrize("capacity", [4096, 16])
def test_packed_documents(spark, capacity):
    rows = [*ROWS, (None, "no key", 0, 0, ""), (3, "again", 0, 0, ""), (3, "again", 0, 0, "")] + [(100 + i, "hot text", 0, 0, "") for i in range(500)]
    texts = [r[1] for r in rows]
    want = []
    for (key, *_), ids in zip(rows, whole(WORDS, texts, 1), strict=True):
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((key, piece, at, len(part), checksum(part)))
    got = pack(spark.createDataFrame(rows, SCHEMA), WORDS, 1, capacity).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.05 * (sum(r.length for r in got) / capacity) + 1


def test_packing_nothing(spark):
    assert pack(spark.createDataFrame([], SCHEMA), WORDS, 1).count() == 0
