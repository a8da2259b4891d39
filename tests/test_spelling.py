"""Spelling matches against a plain regular expression, context, exact lines, both plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wortlaut.functions.bloom import bloom_filter, may_contain
from wortlaut.operators import spelling
from wortlaut.operators.corpus import SEGMENT_SOURCE, Corpus
from wortlaut.operators.results import present
from wortlaut.operators.search import text_tags


def brute_hits(text, pairs):
    """The meaning of a match: one alternation, longest entry first, whole words, left to right."""
    flat = text.replace("\n", " ").replace("\r", " ")
    if not flat.strip():
        return []
    lookup = dict(pairs)
    pattern = re.compile(r"\b(?:%s)\b" % "|".join(re.escape(w) for w in sorted(lookup, key=len, reverse=True)))
    found = []
    for m in pattern.finditer(flat):
        left, right = max(0, m.start() - 40), min(len(flat), m.end() + 40)
        shown = ("…" if left else "") + flat[left:right].strip() + ("…" if right < len(flat) else "")
        found.append((m.group(), lookup[m.group()], shown))
    return found


def random_text(rng, words):
    glue = [" ", " ", " ", "-", ", ", "\n", "  ", "'", ".", " – ", "_"]
    return "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randrange(1, 60)))


LISTS = {
    "words": [("daß", "dass"), ("muß", "muss"), ("Fluß", "Fluss"), ("so", "SO")],
    "pieces": [("so viel", "soviel"), ("viel Zeit", "Vielzeit"), ("so", "SO"), ("so viel Zeit", "X"), ("Zeit-los", "zeitlos")],
    "odd": [("-los", "LOS"), ("los.", "los!"), ("'s", "es"), ("viel", "V"), (" viel", "W")],
}


@pytest.mark.parametrize("name", LISTS)
@pytest.mark.parametrize("inline", [True, False])
def test_matches_are_those_of_the_alternation(spark, name, inline):
    rng, pairs = random.Random(11), LISTS[name]
    words = ["daß", "muß", "so", "viel", "Zeit", "los", "s", "Fluß", "Flußs", "ß", "é", "x1", "naß²"]
    texts = [random_text(rng, words) for _ in range(300)] + ["", " \n", "so viel viel Zeit so viel Zeit-los"]
    rows = [(f"d{i}", i, "", ".", f"d{i}", 0, 0, "p", t, 1) for i, t in enumerate(texts)]
    segments = spark.createDataFrame(
        rows, "doc_id string, doc_ord long, quelle string, subdir string, filename string, owner_id int, seg_no int, "
        "tag string, text string, hint_line int")  # fmt: skip
    spellings = dict(pairs) if inline else spark.createDataFrame(pairs, "alt string, neu string")
    got = spelling.find_spellings(segments, spellings).orderBy("doc_ord", "place").collect()
    want = [(i, *hit) for i, t in enumerate(texts) for hit in brute_hits(t, pairs)]
    assert [(r["doc_ord"], r["gefunden"], r["vorschlag"], r["kontext"]) for r in got] == want
    assert len(want) > 50


def test_empty_word_list(spark, make_corpus):
    segments = make_corpus({"a.xml": "<a>so</a>"}).segments
    assert spelling.find_spellings(segments, spark.createDataFrame([], "alt string, neu string")).count() == 0
    assert spelling.find_spellings(segments, {}).count() == 0


def test_active_list(spark):
    builtin = spark.createDataFrame([("a", "1", 0), ("b", "2", 1)], "alt string, neu string, ord long")
    custom = spark.createDataFrame([("b", "3", 0), ("b", "4", 1), ("c", "", 2)], "alt string, neu string, ord long")
    rows = {m: sorted(map(tuple, spelling.active_spellings(builtin, custom, m).collect())) for m in ("extend", "replace")}
    assert rows == {"extend": [("a", "1"), ("b", "4")], "replace": [("b", "4")]}


FIXTURE = """<?xml version="1.0" encoding="utf-8"?>
<bdo>
  <artikel wb="bwb"
           band="2"
           heft="7">
    <lemma>daß</lemma>
    <bedeutung>Er muß <hi>vor
      dem Haus</hi> warten, daß
      der Regen naß
      wird; herausläßt</bedeutung>
    <bedeutung>ein Flu&#223; und <hi>Fluß</hi></bedeutung>
    <titel>daß</titel>
    <!-- daß --> muß
  </artikel>
</bdo>"""


def test_corpus_report(make_corpus, spark):
    corpus = make_corpus({"x/a.xml": FIXTURE})
    pairs = [("daß", "dass"), ("muß", "muss"), ("naß", "nass"), ("Fluß", "Fluss"), ("läßt", "lässt")]
    report = present(spelling.check_spelling(corpus, spark.createDataFrame(pairs, "alt string, neu string")), "seg_no", "place")
    rows = [(r["line"], r["tag"], r["gefunden"], r["vorschlag"]) for r in report.collect()]
    assert rows == [
        (13, "artikel", "muß", "muss"),
        (6, "lemma", "daß", "dass"),
        (7, "bedeutung", "muß", "muss"),
        (8, "bedeutung", "daß", "dass"),
        (9, "bedeutung", "naß", "nass"),
        (11, "bedeutung", "Fluß", "Fluss"),  # written as a reference; the line holds the plain word as well
        (11, "hi", "Fluß", "Fluss"),
    ]
    assert report.columns == ["quelle", "subdir", "filename", "line", "tag", "gefunden", "vorschlag", "kontext"]
    first = report.first()
    assert (first["quelle"], first["subdir"], first["filename"]) == ("BWB Bd. 2, H. 7", "x", "a.xml")
    plan = spelling.check_spelling(corpus, spark.createDataFrame(pairs, "alt string, neu string"))._jdf.queryExecution()
    assert "MapInArrow" not in plan.executedPlan().toString()  # hits are staged: shredded once
    only = spelling.check_spelling(corpus, spark.createDataFrame(pairs, "alt string, neu string"), ["titel"])
    assert [r["line"] for r in only.collect()] == [12]
    included = text_tags(corpus.segments).filter("tag = 'lemma'")
    assert spelling.check_spelling(corpus, spark.createDataFrame(pairs, "alt string, neu string"), included).count() == 1


def brute_line(word, hint, lines):
    return next((i for i in range(max(1, hint), len(lines) + 1) if word in lines[i - 1]), hint)


def test_exact_lines(make_docs, spark):
    from wortlaut.operators.corpus import source_lines

    rng = random.Random(2)
    ends = ["\n", "\r\n", "\r", "\x85", " ", "\x0b"]
    texts = {f"d{i}": "".join(rng.choice(["ab", "c", "abc", ""]) + rng.choice(ends) for _ in range(rng.randrange(400))) for i in range(12)}
    texts["far"] = "x\n" * 500 + "ab\n" + "y\n" * 10
    asked = [(d, h, w) for d in texts for h in (0, 1, 3, 70, 128, 399, 600) for w in ("ab", "abc", "no")]
    wanted = spark.createDataFrame(asked, "doc_id string, hint_line int, word string")
    got = spelling.exact_lines(wanted, make_docs(texts))
    want = {(d, h, w): brute_line(w, h, texts[d].splitlines()) for d, h, w in asked}
    assert {(r["doc_id"], r["hint_line"], r["word"]): r["line"] for r in got.collect()} == want
    lines = source_lines(make_docs(texts)).groupBy("doc_id").agg(F.max("line_no").alias("n"))
    assert {r["doc_id"]: r["n"] for r in lines.collect()} == {d: len(t.splitlines()) for d, t in texts.items() if t.splitlines()}


def first_line(content, hint, word):
    lines = content.splitlines()
    return next((n for n in range(hint, len(lines) + 1) if word in lines[n - 1]), hint)


def random_document(rng):
    words = ["daß", "so", "viel", "muß", "los", "xdaßx", "Zeit"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "\n", " ", ", ", "-", "&amp;", "&#223;"]) for _ in range(rng.randrange(0, 9)))
    part = lambda: rng.choice([
        f'<p daß="{rng.choice(words)}">{text()}</p>', f"<p\nn='>'>{text()}<b>{text()}</b>{text()}</p>", f"<b/>{text()}",
        f"<!-- {text().replace('--', '')}-->", f"<?so {text()}?>", "\n", f"<p><![CDATA[{text()}]]></p>", f"<b\n/>{text()}",
        f"<p>{'x' * 300} {text()}</p>",
    ])
    end = rng.choice(["", "", "", "\r\n", "\u2028"])
    return f"<a>{''.join(part() + rng.choice(['', text()]) for _ in range(12))}{end}</a>"


@pytest.mark.parametrize("inline", [True, False])
def test_lines_that_a_segment_tells_are_the_exact_ones(spark, make_docs, inline):
    rng, pairs = random.Random(3), [("daß", "dass"), ("muß", "muss"), ("so viel", "soviel"), ("los", "LOS"), ("-so", "S")]
    texts = {f"d{i}.xml": random_document(rng) for i in range(150)}
    corpus = Corpus.of(make_docs(texts), SEGMENT_SOURCE)
    spellings = dict(pairs) if inline else spark.createDataFrame(pairs, "alt string, neu string")
    hits = spelling.find_spellings(corpus.segments, spellings).collect()
    known = [r for r in hits if r["line"] is not None]
    assert len(hits) > 500 and len(known) > 200
    assert [r["line"] for r in known] == [first_line(texts[r["doc_id"]], r["hint_line"], r["gefunden"]) for r in known]
    report = spelling.check_spelling(corpus, spellings, ["a", "b", "p"]).collect()
    want = {(r["doc_id"], r["owner_id"], r["seg_no"], r["place"]): first_line(texts[r["doc_id"]], r["hint_line"], r["gefunden"]) for r in hits}
    assert {(r["doc_id"], r["node_id"], r["seg_no"], r["place"]): r["line"] for r in report} == want


def test_texts_and_blanks_stay_where_they_are(spark, make_docs):
    """What is shuffled for a list above the broadcast limit has neither the text nor its pieces."""
    texts = {f"d{i}.xml": "<a>" + " ".join(["wort", "satz", "zeile"] * 300) + (" daß" if i % 10 == 0 else "") + "</a>" for i in range(50)}
    corpus = Corpus.of(make_docs(texts), SEGMENT_SOURCE)
    pairs = spark.createDataFrame([(f"alt{i}", "x") for i in range(1000)] + [("daß", "dass")], "alt string, neu string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = spelling.find_spellings(corpus.segments, pairs)
        assert hits.count() == 5
        plan = spark._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert any("piece#" in columns and "rest#" in columns for columns in moved) and "SortMergeJoin" in plan
    assert not any("parts#" in columns or "text#" in columns for columns in moved)


def test_bloom_filter(spark):
    kept = spark.range(5000).select((F.col("id") * 3).cast("string").alias("v")).unionByName(spark.createDataFrame([(None,)], "v string"))
    asked = spark.range(15000).select(F.col("id").cast("string").alias("v"), (F.col("id") % 3 == 0).alias("there"))
    found = asked.filter(may_contain(bloom_filter(kept, "v", 1 << 16), F.col("v"), 1 << 16)).groupBy("there").count()
    counts = {r["there"]: r["count"] for r in found.collect()}
    assert counts[True] == 5000 and counts.get(False, 0) < 300
    none = spark.createDataFrame([], "v string")
    assert asked.filter(may_contain(bloom_filter(none, "v"), F.col("v"))).count() == 0
    assert asked.filter(may_contain(bloom_filter(kept, "v"), F.lit(None).cast("string"))).count() == 0
    with pytest.raises(ValueError):
        bloom_filter(kept, "v", 100)


def test_words_of_a_document_are_looked_for_once(spark, make_docs):
    """An array of words gives a row for each, and the documents are searched in one place of the plan."""
    texts = {"a.xml": "x\n" + "ab cd\n" * 2 + "ef\n" * 90 + "gh", "b.xml": "ab"}
    asked = [("a.xml", 2, ["ab", "gh", "ef", "no", "d\ne"]), ("a.xml", 0, ["x"]), ("b.xml", 5, ["ab"]), ("b.xml", 1, [])]
    wanted = spark.createDataFrame(asked, "doc_id string, hint_line int, words array<string>")
    found = spelling.exact_lines(wanted, make_docs(texts))
    got = {(r["doc_id"], r["hint_line"], r["word"]): r["line"] for r in found.collect()}
    assert got == {(d, h, w): brute_line(w, h, texts[d].splitlines()) for d, h, words in asked for w in words}
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert plan.split("== Initial Plan ==")[-1].count("ArrowEvalPython") == 1
