"""Files in, files out: scans, archives, CSV lists, index, source lines."""

import io
import zipfile
from urllib.parse import unquote

from pyspark.sql import functions as F

from wortlaut.operators.corpus import Corpus
from wortlaut.operators.search import find_path
from wortlaut.operators.spelling import active_spellings
from wortlaut.sources import documents, index, results, wordlists


def test_scan(spark, tmp_path):
    (tmp_path / "sub dir" / "ä").mkdir(parents=True)
    files = {
        "a.xml": b"<a/>",
        "sub dir/b.xml": b" \n<?xml version='1.0'?><b/>",
        "sub dir/ä/c.xml": b"\xef\xbb\xbf<c/>",
        "fake.xml": b"no markup",
        "late.xml": b" " * 100 + b"<a/>",
        "upper.XML": b"<a/>",
        "note.txt": b"<a/>",
        "long.xml": b"<a>" + b"x" * 3000 + b"</a>",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    docs = documents.scan_corpus(spark, str(tmp_path))
    got = {r["doc_id"]: (r["subdir"], r["filename"], r["size_kb"]) for r in docs.drop("content").collect()}
    assert got == {
        "a.xml": (".", "a.xml", 0.0), "sub dir/b.xml": ("sub dir", "b.xml", 0.03),
        "sub dir/ä/c.xml": ("sub dir/ä", "c.xml", 0.01), "long.xml": (".", "long.xml", round(3007 / 1024, 2))}
    assert documents.scan_corpus(spark, str(tmp_path), strict_sniff=True).count() == 3
    # a corpus from files has path order; blanks before an XML declaration pass the sniff but not the parser
    corpus = Corpus.of(docs)
    assert [r["doc_id"] for r in corpus.parse_errors.collect()] == ["sub dir/b.xml"]
    assert [r["doc_id"] for r in corpus.nodes.orderBy("doc_ord").collect()] == ["a.xml", "long.xml", "sub dir/ä/c.xml"]


def pack(members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for name, content in members.items():
            archive.writestr(name, content)
    return bytearray(data.getvalue())


def test_archives(spark):
    good = pack({"d/a.xml": "<a/>", "B.XML": "<b/>", "note.txt": "<x/>", "fake.xml": "x", "../up.xml": "<x/>", "/abs.xml": "<x/>"})
    rows = [("good.zip", good), ("big.zip", pack({"a.xml": "<a/>", "b.bin": "0" * 2000})), ("bad.zip", bytearray(b"PK nonsense")),
            ("empty.zip", pack({}))]
    members = documents.expand_archives(spark.createDataFrame(rows, "path string, content binary"), max_bytes=1000)
    got = sorted((r["archive"], r["archive_error"], r["path"]) for r in members.collect())
    assert got == [("bad.zip", "bad archive", None), ("big.zip", "too large", None), ("good.zip", None, "B.XML"), ("good.zip", None, "d/a.xml")]
    docs = documents.archive_docs(members)
    assert sorted((r["subdir"], r["filename"]) for r in docs.collect()) == [("good.zip", "B.XML"), ("good.zip/d", "a.xml")]
    assert find_path(Corpus.of(docs).nodes, "a").first()["subdir"] == "good.zip/d"


def test_intake(spark):
    rows = [("a.xml", b"<a/>"), ("b.xml", b"text"), ("c.txt", b"<a/>"), ("d.xml", b"<a>" + b"x" * 5000), ("e.zip", bytes(pack({"a.xml": "<a/>"}))),
            ("f.zip", b"PK"), ("g.ZIP", b"x" * 5000)]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    report = documents.intake_report(files, max_bytes=2000)
    assert {r["path"]: r["status"] for r in report.collect()} == {
        "a.xml": "accepted", "b.xml": "not_xml", "c.txt": "ignored", "d.xml": "too_large", "e.zip": "accepted",
        "f.zip": "bad_archive", "g.ZIP": "too_large"}
    assert {r["status"]: r["files"] for r in documents.intake_totals(report).collect()}["accepted"] == 2


def test_index(spark):
    paths = ["Z/a.xml", "a/b/c.XML", "a/b/.h.xml", "a/n.txt", "top.xml", "a/B2/d.xml"]
    rows = index.directory_index(spark.createDataFrame([(p, 2048) for p in paths], "path string, length long"))
    got = {r["path"]: (r["is_dir"], r["depth"], r["file_count"], r["size_kb"]) for r in rows.collect()}
    assert got == {
        "Z": (True, 0, 1, None), "a": (True, 0, 2, None), "a/b": (True, 1, 1, None), "a/B2": (True, 1, 1, None),
        "Z/a.xml": (False, 1, None, 2.0), "a/b/c.XML": (False, 2, None, 2.0), "a/n.txt": (False, 1, None, 2.0),
        "a/B2/d.xml": (False, 2, None, 2.0)}
    ordered = [r["path"] for r in rows.orderBy(index.index_order()).collect()]
    assert ordered == ["a", "a/b", "a/b/c.XML", "a/B2", "a/B2/d.xml", "a/n.txt", "Z", "Z/a.xml"]
    assert {r["path"] for r in index.search_index(rows, "C.x").collect()} == {"a", "a/b", "a/b/c.XML"}

    def chosen(*names):
        return spark.createDataFrame([(n,) for n in names], "path string")

    picked = index.select_paths(rows, chosen("a"), chosen("a/b"))
    assert {r["path"] for r in picked.collect()} == {"a", "a/B2", "a/B2/d.xml", "a/n.txt"}
    assert [r["filename"] for r in index.selected_docs(picked).collect()] == ["d.xml"]
    assert index.select_filtered(rows).count() == 4


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_word_lists(spark, tmp_path):
    custom = write(tmp_path / "c.csv", 'Alte Schreibung ,NEU,x\n" daß ",dass,1\nleer,,2\n"so, viel",soviel,3\n', "utf-8-sig")
    rows = wordlists.read_wordlist(spark, custom).orderBy("ord").collect()
    assert [(r["alt"], r["neu"]) for r in rows] == [("daß", "dass"), ("so, viel", "soviel")]
    builtin = write(tmp_path / "s.csv", "alt;neu;kategorie\nmuß;muss;Verb\n;x;\n")
    assert [(r["alt"], r["neu"]) for r in wordlists.read_spellings(spark, builtin).collect()] == [("muß", "muss")]
    assert wordlists.read_spellings(spark, str(tmp_path / "none.csv")).count() == 0
    assert wordlists.read_whitelist(spark, str(tmp_path / "none.csv")).count() == 0
    white = write(tmp_path / "w.csv", "wort\nMaß\n Maß \n\nStraße\n")
    assert sorted(r["wort"] for r in wordlists.read_whitelist(spark, white).collect()) == ["Maß", "Straße"]
    (tmp_path / "lists").mkdir()
    write(tmp_path / "lists" / "2024.csv", "lemma,n\nAlt,1\n")
    write(tmp_path / "lists" / "2025.csv", "n,lemma\n1,Neu\n2,zwei Wörter\n3,Neu\n")
    assert [r["lemma"] for r in wordlists.read_lemmas(spark, str(tmp_path / "lists")).collect()] == ["Neu"]
    tags = write(tmp_path / "t.csv", "Tag,Inkludiert\nForm,Nein\nsense,JA\n")
    assert [tuple(r) for r in wordlists.read_tag_selection(spark, tags).collect()] == [("form", "nein"), ("sense", "ja")]


def lines_of(folder):
    return [line for part in sorted(folder.glob("part-*")) for line in part.read_text(encoding="utf-8").splitlines()]


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("muß", "muss"), ("Fluß", "Fluss"), ("aß", "ass")], "alt string, neu string").coalesce(1)
    wordlists.write_spellings(pairs, str(tmp_path / "s"))
    assert lines_of(tmp_path / "s") == ["alt;neu", "aß;ass", "Fluß;Fluss", "muß;muss"]
    assert wordlists.read_spellings(spark, str(tmp_path / "s")).count() == 3
    words = spark.createDataFrame([("b",), ("A",), ("b",)], "wort string")
    wordlists.write_whitelist(words, str(tmp_path / "w"))
    assert lines_of(tmp_path / "w") == ["wort", "A", "b"]
    ledger = spark.createDataFrame([("z", 2, "e;f", "t"), ("a", 1, "x", "t")], wordlists.LEDGER)
    wordlists.write_ledger(ledger, str(tmp_path / "l"))
    again = wordlists.read_ledger(spark, str(tmp_path / "l"))
    assert sorted(map(tuple, again.collect())) == [("a", 1, "x", "t"), ("z", 2, "e;f", "t")]
    assert wordlists.read_ledger(spark, str(tmp_path / "no")).count() == 0


def test_results(spark, make_corpus, make_docs, tmp_path):
    files = {"x/a.xml": "<r>\n<s>one</s>\n\n<s>two</s>\r\n</r>"}
    hits = find_path(make_corpus(files).nodes, "s")
    assert results.write_results(hits, str(tmp_path / "r"))
    got = lines_of(tmp_path / "r")
    assert got[0] == "quelle;subdir;filename;line;full_path;text_content"
    assert sorted(line for line in got if not line.startswith("quelle")) == ['"";x;a.xml;2;r/s;one', '"";x;a.xml;4;r/s;two']
    assert not results.write_results(hits.filter("line > 99"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    shown = results.with_source_lines(hits, make_docs(files), before=1, after=1)
    rows = sorted((r["line"], r["line_no"], r["text"], r["is_hit"]) for r in shown.collect())
    assert rows == [(2, 1, "<r>", False), (2, 2, "<s>one</s>", True), (2, 3, "", False),
                    (4, 3, "", False), (4, 4, "<s>two</s>", True), (4, 5, "</r>", False)]


def test_long_documents_are_met_by_blocks(spark, make_docs):
    text = "\n".join(f"line {i}" for i in range(1, 1000))
    hits = spark.createDataFrame([("d", n) for n in (1, 63, 64, 65, 999)], "doc_id string, line int")
    shown = results.with_source_lines(hits, make_docs({"d": text}), before=2, after=100).groupBy("line").agg(F.count("*").alias("n"))
    assert {r["line"]: r["n"] for r in shown.collect()} == {1: 101, 63: 103, 64: 103, 65: 103, 999: 3}


def test_rows_of_several_files_keep_their_order(spark, tmp_path):
    """Spark packs large files first; the order of a list is that of its files' names and lines all the same."""
    for name, lines in (("0.csv", 3), ("1.csv", 2000), ("2.csv", 40)):
        rows = "".join(f"w{i % 3},{name}-{i}\n" for i in range(lines))
        (tmp_path / name).write_text("alt,neu\n" + rows)
    table = wordlists.read_wordlist(spark, str(tmp_path))
    got = [r["neu"] for r in table.orderBy("ord").collect()]
    assert got == [f"{n}-{i}" for n, k in (("0.csv", 3), ("1.csv", 2000), ("2.csv", 40)) for i in range(k)]
    none = wordlists.read_spellings(spark, str(tmp_path / "missing.csv"))
    active = {r["alt"]: r["neu"] for r in active_spellings(none, table).collect()}
    assert active == {"w0": "2.csv-39", "w1": "2.csv-37", "w2": "2.csv-38"}


def test_line_ends_inside_fields(spark, tmp_path):
    (tmp_path / "list.csv").write_text('alt,neu\n"a b","x\ny"\nc,d\n')
    got = [r["neu"] for r in wordlists.read_wordlist(spark, str(tmp_path / "list.csv"), multi_line=True).orderBy("ord").collect()]
    assert got == ["x\ny", "d"]


def test_one_damaged_archive_is_one_row(spark):
    def packed(damage):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a.xml", "<a>" + "text " * 500 + "</a>")
        data = bytearray(out.getvalue())
        if damage:
            data[40:60] = b"\xff" * 20
        return data

    rows = [("good.zip", packed(False)), ("bad.zip", packed(True)), ("none.zip", None)]
    archives = spark.createDataFrame(rows, "path string, content binary")
    got = {r["archive"]: r["archive_error"] for r in documents.expand_archives(archives).collect()}
    assert got == {"good.zip": None, "bad.zip": "bad archive", "none.zip": "bad archive"}


def test_index_is_written_per_directory(spark, tmp_path):
    files = spark.createDataFrame([("a/b/c.xml", 10), ("a/n.txt", 2048), ("z/a.xml", 1)], "path string, length long")
    rows = index.directory_index(files)
    index.write_index(rows, str(tmp_path / "index"))
    key = lambda r: r["path"]
    assert sorted(index.read_index(spark, str(tmp_path / "index")).collect(), key=key) == sorted(rows.collect(), key=key)
    part = index.read_index(spark, str(tmp_path / "index"), "z")
    assert sorted(r["path"] for r in part.collect()) == ["z", "z/a.xml"]


def test_one_directory_of_an_index_reads_its_own_files(spark, tmp_path):
    paths = [f"{top}/{sub}/f{i}.xml" for top in ("a", "ab", "z z%ü") for sub in "xyz" for i in range(40)]
    rows = index.directory_index(spark.createDataFrame([(p, 10) for p in paths], "path string, length long"))
    index.write_index(rows, str(tmp_path))

    def read(*args, **options):
        part = index.read_index(spark, str(tmp_path), *args, **options)
        found = sorted(r["path"] for r in part.collect())
        plan = part._jdf.queryExecution().executedPlan()
        files = plan.collectLeaves().apply(0).metrics().apply("numFiles").value()
        return found, files

    for directory in ("a", "a/x", "z z%ü", "z z%ü/y", "none"):
        folders = [f for f in tmp_path.iterdir() if f.name.startswith("directory=")]
        name = lambda f: unquote(f.name.partition("=")[2])
        own = sum(len(list(f.glob("part-*"))) for f in folders if name(f) == directory)
        under = own + sum(len(list(f.glob("part-*"))) for f in folders if name(f).startswith(f"{directory}/"))
        known = [p for p in paths if p.startswith(f"{directory}/")]
        found, files = read(directory)
        assert files == under and [p for p in found if p.endswith(".xml")] == sorted(known)
        found, files = read(directory, below=False)
        assert files == own and [p for p in found if p.endswith(".xml")] == sorted(p for p in known if p.count("/") == directory.count("/") + 1)


def test_a_null_path_selects_nothing(spark):
    files = spark.createDataFrame([("a/b/c.xml", 10), ("z/a.xml", 1)], "path string, length long")
    chosen = spark.createDataFrame([(None,), ("a/b",)], "path string")
    got = index.select_paths(index.directory_index(files), chosen)
    assert sorted(r["path"] for r in got.collect()) == ["a/b", "a/b/c.xml"]


def test_report_is_computed_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            runs.add(len(frame))
            yield frame

    rows = spark.range(10).mapInPandas(count, "id long")
    assert results.write_results(rows, str(tmp_path / "full")) and runs.value == 10
    assert not results.write_results(rows.filter("id < 0"), str(tmp_path / "empty")) and not (tmp_path / "empty").exists()
