"""Shredding: text, tails, names, lines, errors; and what must hold for any document."""

import random

import pytest
from pyspark.sql import functions as F

from wortlaut.operators.corpus import Corpus
from wortlaut.operators.search import find_path
from wortlaut.operators.shred import _NODE_COLUMNS, parse_document, shred


def rows_of(xml):
    return [dict(zip(_NODE_COLUMNS, r)) for r in parse_document(xml if isinstance(xml, bytes) else xml.encode())[0]]


def element(rows, tag):
    return next(r for r in rows if r["tag"] == tag)


def test_mixed_content():
    rows = rows_of("<a>one<b>two</b>three<!-- note -->four<?pi x?>five<c/><![CDATA[<six>]]>&amp;&#223;</a>")
    a, b, c = (element(rows, t) for t in "abc")
    assert (a["text"], b["text"], b["tail"], c["text"], c["tail"]) == ("one", "two", "three", None, "<six>&ß")
    assert [(r["kind"], r["tail"], r["child_no"]) for r in rows if r["kind"] in ("comment", "pi")] == [
        ("comment", "four", 1), ("pi", "five", 2)]
    assert a["string_len"] == len("onetwothreefourfive<six>&ß")
    assert a["children"] == "b|c" and (a["node_id"], a["end_id"]) == (0, 2)


def test_names_and_namespaces():
    rows = rows_of('<x:a xmlns="urn:d" xmlns:x="urn:x" xml:id="i" id="p" x:q="v"><b/></x:a>')
    a, b = element(rows, "a"), element(rows, "b")
    assert (a["ns"], b["ns"], b["path"]) == ("urn:x", "urn:d", "a/b")
    assert a["attrs"] == [
        ("{http://www.w3.org/XML/1998/namespace}id", "id", "i"), ("id", "id", "p"), ("{urn:x}q", "q", "v")]


def test_line_is_where_the_start_tag_ends():
    rows = rows_of('<?xml version="1.0"?>\r\n<a\n  x="1 > 0"\n  y="it\'s">\n<!-- c\nc --><b/>\n</a>')
    assert element(rows, "a")["line"] == 4
    assert next(r for r in rows if r["kind"] == "comment")["line"] == 6
    assert element(rows, "b")["line"] == 6


@pytest.mark.parametrize("xml", ["", "<a>", "<a></b>", "<a><b></a>", "plain", "<a/><b/>", "<x:a/>", "<a>&nix;</a>"])
def test_broken_documents_give_one_error_row(xml):
    rows = rows_of(xml)
    assert len(rows) == 1 and rows[0]["kind"] == "error" and rows[0]["error"]


def test_encodings():
    assert element(rows_of("<a>ß</a>".encode("utf-8-sig")), "a")["text"] == "ß"
    assert element(rows_of('<?xml version="1.0" encoding="iso-8859-1"?><a>ß</a>'.encode("latin-1")), "a")["text"] == "ß"
    rows = rows_of('<?xml version="1.0" encoding="utf-16"?>\n<a>\n<b\n/>ß</a>'.encode("utf-16"))
    assert element(rows, "b")["tail"] == "ß" and element(rows, "b")["line"] == 4


def test_entities():
    rows = rows_of('<!DOCTYPE a [\n<!ENTITY e "<b k=\'1\'>x &lt;</b>">\n<!ENTITY t "y">]>\n<a>&t;\n&e;\n<c/>\n</a>')
    a, b, c = (element(rows, t) for t in "abc")
    assert (a["text"], b["text"], b["attrs"]) == ("y\n", "x <", [("k", "k", "1")])
    assert (a["line"], b["line"], c["line"]) == (4, 5, 6)
    outside = '<!DOCTYPE a SYSTEM "nowhere.dtd" [<!ENTITY x SYSTEM "file:///etc/hostname">]><a>1&x;2&uuml;3</a>'
    assert element(rows_of(outside), "a")["text"] == "123"  # nothing is fetched
    bomb = "".join(f'<!ENTITY e{i} "{f"&e{i - 1};" * 10}">' for i in range(1, 9))
    assert rows_of(f'<!DOCTYPE a [<!ENTITY e0 "xxxxxxxxxx">{bomb}]><a>&e8;</a>')[0]["kind"] == "error"


def test_depth_is_limited_only_on_request(make_docs):
    deep = "<a>" * 300 + "</a>" * 300
    assert len(rows_of(deep)) == 300
    docs = make_docs({"deep.xml": deep})
    assert shred(docs).count() == 300 and shred(docs, max_depth=300).filter("kind = 'element'").count() == 300
    assert [r["kind"] for r in shred(docs, max_depth=299).collect()] == ["error"]


def random_xml(rng, depth=0):
    inside = "".join(
        rng.choice(["", "text ", "ß\n", "&lt;", "<!--c-->", random_xml(rng, depth + 1) if depth < 5 else ""])
        for _ in range(rng.randrange(5))
    )
    tag = rng.choice("abc")
    return f"<{tag}>{inside}</{tag}>"


def test_properties(make_corpus):
    rng = random.Random(7)
    corpus = make_corpus({f"d{i}.xml": random_xml(rng) for i in range(60)})
    nodes, segments = corpus.nodes.cache(), corpus.segments
    assert corpus.parse_errors.count() == 0
    # an element's text length is that of the segments owned inside its interval
    inside = nodes.alias("n").join(
        segments.alias("s"),
        (F.col("n.doc_id") == F.col("s.doc_id")) & F.col("s.owner_id").between(F.col("n.node_id"), F.col("n.end_id")),
        "left",
    )
    sums = inside.groupBy("n.doc_id", "n.node_id", "n.string_len").agg(F.sum(F.length("s.text")).alias("l"))
    assert sums.filter(F.coalesce("l", F.lit(0)) != F.col("string_len")).count() == 0
    # children lie in their parent's interval, one level deeper
    pairs = nodes.alias("c").join(
        nodes.alias("p"),
        (F.col("c.doc_id") == F.col("p.doc_id")) & (F.col("c.parent_id") == F.col("p.node_id")),
    )
    wrong = (F.col("c.end_id") > F.col("p.end_id")) | (F.col("c.depth") != F.col("p.depth") + 1)
    wrong |= F.col("c.path") != F.concat("p.path", F.lit("/"), "c.tag")
    assert pairs.filter(wrong).count() == 0 and pairs.count() == nodes.filter("depth > 0").count()
    assert nodes.filter("first_in_doc").count() == nodes.select("doc_id", "path").distinct().count()
    assert find_path(nodes, "b").count() == nodes.filter("tag = 'b'").count()


def test_large_documents_and_batches(make_corpus):
    body = "".join(f'<e n="{i}">t{i}</e>\n' for i in range(50_000))
    corpus = make_corpus({"big.xml": f"<r>{body}</r>", "bad.xml": "<r><e></r>", "small.xml": "<r/>"})
    got = {(r["doc_id"], r["count"]) for r in corpus.nodes.groupBy("doc_id").count().collect()}
    assert got == {("big.xml", 50_001), ("small.xml", 1)}
    assert [r["filename"] for r in corpus.parse_errors.collect()] == ["bad.xml"]
    attrs = corpus.nodes.filter("tag = 'e'").select(F.sum(F.col("attrs")[0]["value"].cast("long"))).first()[0]
    assert attrs == sum(range(50_000))


def test_save_and_load(make_corpus, spark, tmp_path):
    corpus = make_corpus({"a/x.xml": "<a><b>t</b></a>", "y.xml": "<a"})
    corpus.save(str(tmp_path / "c"))
    again = Corpus.load(spark, str(tmp_path / "c"))
    assert again.nodes.count() == 2 and again.parse_errors.count() == 1 and again.docs.count() == 2
    assert again.document("a/x.xml").nodes.count() == corpus.document("a/x.xml").nodes.count() == 2
    assert find_path(again.nodes, "a/b").first()["full_path"] == "a/b"


def test_bucketed_tables_group_by_document_without_a_shuffle(make_corpus, spark):
    from wortlaut.operators import nesting, unique

    files = {f"d{i}.xml": f'<a n="{i % 2}"><b n="{i % 3}">t</b><b n="x">t</b></a>' for i in range(40)}
    corpus = make_corpus(files)
    corpus.save_tables("shelf", 4)
    again = Corpus.load_tables(spark, "shelf")
    for check in (lambda n: unique.dup_attr(n, "n"), lambda n: unique.dup_contents(n, "b"), lambda n: nesting.tag_stats(n, "b")):
        saved = check(again.nodes)
        assert "Exchange" not in saved._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, saved.collect())) == sorted(map(str, check(corpus.nodes).collect()))
