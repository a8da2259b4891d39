"""The pipeline against the same steps in plain Python, and the registered queries against their SQL."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import difference, duck
from wortlaut.llm import queries
from wortlaut.llm.encode import Encoder
from wortlaut.llm.mixing import draw_mix
from wortlaut.llm.quality import score_quality
from wortlaut.llm.simhash import fingerprint

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.mark.parametrize("name", queries.ORACLES)
def test_queries_with_sql(spark, name):
    assert difference(spark, duck(SF_DIR), name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) is None


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def kept_texts(spark, docs):
    """The first three stages in plain Python."""
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    good = {r.doc_id for r in score_quality(docs, labels).collect() if r.predicted}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    last = {}
    for k, r in sorted(rows.items()):
        last["".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)] = k
    prints = {k: fingerprint(rows[k].text) % 2**64 for k in last.values()}
    group = {k: k for k in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    return {k: rows[k] for k in prints if group[k] == k}


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = kept_texts(spark, docs)
    assert 0 < len(kept) < docs.count()
    table, columns = docs, docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, SF_DIR).write.parquet(str(tmp_path / str(i)))
        table = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert table.columns == columns
        if i == 2:
            assert {r.doc_id: r for r in table.collect()} == kept
            copies = {r.doc_id: r.copies for r in draw_mix(table).collect() if r.copies}
        if i == 3:
            assert Counter(r.doc_id for r in table.collect()) == Counter(copies)
    encoder, want = Encoder(queries.vocabulary("word_bpe_49k.json")), Counter()
    for key, ids in zip(copies, encoder.encode([kept[k].text for k in copies]), strict=True):
        ids = [*ids.tolist(), 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want[key, piece, at, len(part), zlib.crc32(part.tobytes())] += copies[key]
    assert Counter(tuple(r)[:5] for r in table.collect()) == want
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert Counter(tuple(r)[:5] for r in whole.collect()) == want
    room = Counter()
    for r in whole.collect():
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 4096


def test_stages_with_nulls_odd_names_and_long_texts(spark, tmp_path):
    """Rows without keys, texts or sources, equal rows, clashing and dotted column names, a very long text, nothing."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60).drop("n_chars")
    long = " ".join(f"word{i % 997} of a long and clean document," for i in range(40_000))
    extra = [(None, "a text without a key, long enough to be kept here.", "en", "web"), (None, None, None, None), (10**9, "", "en", None),
             (10**9 + 1, long, "en", "web"), (10**9 + 1, long, "en", "web"), (10**9 + 2, "twin " + long, "en", None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for name in ("a.b", "_doc", "_key", "_copies", "mark", "size", "_text", "fingerprint", "_words"):
        docs = docs.withColumn(name, F.lit(name))
    for i, table in enumerate((docs, docs.limit(0))):
        columns = table.columns
        for j, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{i}-{j}")
            stage(spark, table, SF_DIR).write.parquet(path)
            table = spark.read.parquet(path)
            if j < 4:
                assert table.columns == columns
            if j == 2 and not i:
                kept = [r.doc_id for r in table.filter("doc_id >= 1000000000").collect()]
                assert kept.count(10**9 + 1) <= 1 and len(kept) == len(set(kept))
                last = table.count()
        assert table.isEmpty() == bool(i)
    assert last > 20
