"""Search, uniqueness, nesting and statistics on small documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wortlaut.functions.text import round_one_decimal
from wortlaut.operators import nesting, search, unique
from wortlaut.operators.results import present

NESTED = """<entry><sense><sense><sense/></sense></sense><sense><cit><sense/></cit></sense><gramGrp/>
<cit><bibl/><x><bibl/></x></cit></entry>"""


def details(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_nesting(make_corpus):
    nodes = make_corpus({"n.xml": NESTED}).nodes
    assert details(nesting.nesting(nodes, " sense "), "depth", "details") == [(2, "sense > sense"), (3, "sense > sense > sense")]
    assert details(nesting.nesting(nodes, "sense", direct=False), "depth", "details") == [
        (2, "sense > cit > sense"), (2, "sense > sense"), (3, "sense > sense > sense")]


def brute_paths(paths, query):
    """Wildcard search by its meaning: every step strictly below the one before."""
    steps = query.lower().strip().split("/")

    def found(path, steps):
        if path[-1] != steps[-1] and steps[-1] != "*":
            return False
        return len(steps) == 1 or any(found(path[:i], steps[:-1]) for i in range(1, len(path)))

    return sorted(p for p in paths if found(p.split("/"), steps))


@pytest.mark.parametrize("query", ["sense/*/sense", "*/bibl", "entry/*", "*/*/*", "cit/*/bibl", "*", "sense/sense/*/x"])
def test_wildcards(make_corpus, query):
    nodes = make_corpus({"n.xml": NESTED}).nodes
    paths = [r["path"] for r in nodes.collect()]
    if "/" not in query:  # without a slash a star is an ordinary name
        assert search.find_path(nodes, query).count() == 0
        return
    assert sorted(r["full_path"] for r in search.find_path(nodes, query).collect()) == brute_paths(paths, query)


def test_search_quirks(make_corpus):
    nodes = make_corpus({"n.xml": NESTED}).nodes
    assert search.find_path(nodes, "gramGrp").count() == 0  # the query is lower-cased
    assert search.find_pattern(nodes, "gramGrp").count() == 1
    for empty_step in ("entry//sense", "entry/", "/entry"):
        assert search.find_path(nodes, empty_step).count() == 0
    assert search.find_pattern(nodes, " / ").count() == nodes.count()
    assert search.find_pattern(nodes, "sense/*/sense").count() == 2
    assert search.find_path(nodes, "entry/sense").count() == 2


def test_previews(make_corpus):
    text = "  " + "ä" * 120 + " "
    row = search.find_path(make_corpus({"p.xml": f"<a>{text}</a>"}).nodes, "a").first()
    assert row["text_content"] == "ä" * 100 + "..."


def test_content_search(make_corpus):
    nodes = make_corpus({"b.xml": "<r><a>x  y</a><a>\n  </a><a>  </a><a/><b>x\ny</b><a> x\t y</a></r>"}).nodes

    def texts(*args, **kw):
        return [r["text"] for r in present(search.search_content(nodes, *args, **kw)).collect()]

    assert texts(["a"], "x  y") == ["x··y"]
    assert texts(["a", "b"], "x y", normalise=True) == ["x·y", "x·y", "x·y"]
    assert texts(["a"], "") == ["x··y", "··", " x\t·y"]
    assert texts(["a"], "", normalise=True) == ["x·y", "x·y"]
    assert texts(["a"], " \n", normalise=True) == []
    assert texts(["b"], "x") == ["x↵\ny"]
    assert texts(nodes.filter("tag = 'b'"), "x") == ["x↵\ny"]
    assert texts(nodes.filter("tag = 'none'"), "x") == []
    assert [search.tag_exists(nodes, t).first()[0] for t in ("b", "c")] == [True, False]


def test_uniqueness(make_corpus):
    xml = """<r>
<a xml:id="1" id="x">one</a>
<a xml:id="2" id="x"> one </a>
<b xml:id="1" id="">two</b>
<a id="y">
</a></r>"""
    nodes = make_corpus({"d.xml": xml, "e.xml": "<r><a>one</a></r>"}).nodes
    rows = [r.asDict() for r in present(unique.dup_tags(nodes, "a")).collect()]
    assert [(r["filename"], r["line"], r["error_type"], r["details"]) for r in rows] == [
        ("d.xml", 2, "Tag 'a' kommt 3x vor", "Erwartet: 1x, Gefunden: 3x")]
    assert details(unique.dup_contents(nodes, "a"), "line", "error_type", "details") == [
        (2, "Inhalt 'one' in Tag 'a' kommt 2x vor", "Zeilen: 2, 3")]
    assert details(unique.dup_attr_in_tag(nodes, "a", "id"), "error_type", "details") == [
        ("Attribut 'id' mit Wert 'x' in Tag 'a' kommt 2x vor", "Zeilen: 2, 3")]
    assert details(unique.dup_attr(nodes, "xml:id"), "line", "error_type", "details") == [
        (2, "Attribut 'xml:id' mit Wert '1' kommt 2x vor", "In: a:2, b:4")]
    clark = "{http://www.w3.org/XML/1998/namespace}id"
    assert unique.dup_attr(nodes, clark).first()["error_type"] == f"Attribut '{clark}' mit Wert '1' kommt 2x vor"


def test_statistics_keep_documents_without_the_tag(make_corpus):
    nodes = make_corpus({"a.xml": "<r><s>ab<t>c</t></s><s/></r>", "b.xml": "<r/>", "c.xml": "<r"}).nodes
    rows = present(nesting.tag_stats(nodes, "s")).collect()
    assert [(r["filename"], r["count"], r["min_length"], r["max_length"], r["avg_length"]) for r in rows] == [
        ("a.xml", 2, 0, 3, 1.5), ("b.xml", 0, None, None, None)]


def test_rounding_is_pythons(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(10**6), rng.randrange(1, 400)) for _ in range(3000)] + [(1, 4), (1, 20), (123456789, 8)]
    df = spark.createDataFrame(pairs, "s long, n long")
    for s, n, got in df.select("s", "n", round_one_decimal(F.col("s") / F.col("n"))).collect():
        assert got == round(s / n, 1), (s, n)


def test_text_tags_and_selection(make_corpus, spark):
    from wortlaut.sources.wordlists import apply_tag_selection

    corpus = make_corpus({"t.xml": "<r><a>x</a>tail<b> <c/> y</b><titel>t</titel><d>\n</d></r>"})
    tags = search.text_tags(corpus.segments)
    assert details(tags, "tag", "included") == [("a", True), ("b", True), ("r", True), ("titel", False)]
    moved = search.exclude_tags(search.include_tags(tags, "titel"), "a")
    assert details(moved.filter("included"), "tag") == [("b",), ("r",), ("titel",)]
    table = spark.createDataFrame([("a", "nein"), ("titel", "JA"), ("zzz", "ja")], "tag string, inkludiert string")
    assert details(apply_tag_selection(tags, table), "tag", "included") == [
        ("a", False), ("b", True), ("r", True), ("titel", True)]


def test_hits_of_a_tag_are_found_by_regex_too(make_corpus):
    rng = random.Random(5)
    xml = "<r>" + "".join(rng.choice(["<s><s/></s>", "<c><s/></c>", "<s>t</s>"]) for _ in range(200)) + "</r>"
    nodes = make_corpus({"r.xml": xml}).nodes
    assert search.find_path(nodes, "s").count() == len(re.findall("<s", xml))
