"""Large files in splits against the same files shredded whole."""

import pytest

from wortlaut.operators.shred import shred
from wortlaut.operators.split_shred import _opening, shred_entries
from wortlaut.sources.documents import scan_corpus

ENTRY = '<e n="{0}" x:k="v">\n  <form>{1}</form> mid &amp; {0}<?pi a?>\n <sense><def>d{0}</def><!-- </f> --></sense>\n</e>'


def big_file(n, root='dict xmlns="urn:d" xmlns:x="urn:x" wb="BWB" band="3"', head='<?xml version="1.0"?>\n<!DOCTYPE dict [<!ENTITY a "ä">]>\n'):
    entries = "\n  ".join(ENTRY.format(i, "w&a;" if i % 3 else "w") for i in range(n))
    return f"{head}<{root}>\n <meta>\n<e2/>top</meta> t0 {entries}\n last <!-- end --> text</{root.split()[0]}>\n<!-- after -->\n"


FILES = {
    "plain.xml": big_file(40),
    "sub/none.xml": "<dict>\n<other/>\n</dict>",
    "sub/one.xml": "<dict><e>a</e></dict>",
    "sub/first.xml": "<dict><e>a</e>\n<new/><e/><e>b</e></dict>",
    "sub/label.xml": '<dict><e>a</e><?x?><e wb="bwb" heft="7"/><e>b</e><e wb="bwb" band="9">c</e></dict>',
    "sub/late.xml": '<dict><e>a</e><e/><!-- c --><e wb="bwb">b</e></dict>',
    "odd/nested.xml": "<dict><e>a<e>b</e></e><e>c</e></dict>",
    "odd/deeper.xml": "<dict><part><e>a</e><e>b</e></part></dict>",
    "odd/comment.xml": "<dict><e>a</e><!-- <e></e> --><e>b\n</e></dict>",
    "odd/cdata.xml": "<dict><e><![CDATA[</e>]]></e><e>c</e></dict>",
    "bad/tag.xml": "<dict>\n<e>a</e>\n<e>b<c></e></dict>",
    "bad/open.xml": "<dict>\n<e>a</e>\n<e>b</e>",
    "bad/twice.xml": "<dict><e>a</e></dict><dict><e>b</e></dict>",
    "bad/empty.xml": "",
    "bad/text.xml": "no xml",
    "latin.xml": "<?xml version='1.0' encoding='ISO-8859-1'?>\n<dict><e>\xe4</e>\n<e>\xfc\xe9</e></dict>".encode("latin-1"),
    "utf16.xml": "<?xml version='1.0' encoding='UTF-16'?>\n<dict><e>ä</e>\n<e>b</e></dict>".encode("utf-16"),
    "bom.xml": "\ufeff<dict>\n<e>a</e><e>b</e></dict>".encode(),
    "root.xml": "<e>a<f/></e>",
}


def rows(df):
    return sorted((str(r.doc_id), r.node_id if r.node_id is not None else -1, r.kind, repr(r)) for r in df.collect())


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("split_bytes, chunk_bytes", [(10**8, 400), (250, 10**6), (600, 1)])
def test_splits_give_the_rows_of_whole_files(spark, tmp_path, small_splits, split_bytes, chunk_bytes):
    for name, content in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    want = rows(shred(scan_corpus(spark, str(tmp_path))))
    small_splits(split_bytes)
    assert rows(shred_entries(spark, str(tmp_path), "e", chunk_bytes=chunk_bytes)) == want


def test_a_large_file_is_work_for_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "large.xml").write_text(big_file(40_000))
    want = rows(shred(scan_corpus(spark, str(tmp_path))))
    small_splits(1 << 18)
    from wortlaut.sources.documents import scan_records

    records = scan_records(spark, str(tmp_path), "</e>")
    assert records.rdd.getNumPartitions() >= 16 and records.select("split").distinct().count() >= 16
    got = shred_entries(spark, str(tmp_path), "e", columns=["doc_id", "node_id", "path", "line", "text", "tail", "first_in_doc"])
    whole = shred(scan_corpus(spark, str(tmp_path)), got.columns)
    assert rows(got) == rows(whole) and len(want) == got.count()


def test_openings():
    assert _opening(b'<?xml version="1.0"?><!-- <a> --><p:r a=">" b=\'"\'>x') == (b'<?xml version="1.0"?><!-- <a> --><p:r a=">" b=\'"\'>', b"p:r")
    assert _opening(b"") is None and _opening(b"text") is None
