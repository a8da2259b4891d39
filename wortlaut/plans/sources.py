"""Registered queries over document sources: sniffing, archives, intake, directory index, selection, labels."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wortlaut.functions.sizes import scratch_path
from wortlaut.functions.text import source_key
from wortlaut.operators.corpus import DOC_KEYS, Corpus
from wortlaut.plans.common import Registry, escaped, page_docs, spread, table
from wortlaut.sources import documents, index

registry = Registry()


@registry.add(
    "a1_corpus_scan",
    """SELECT 'pages' AS subdir, 'p' || page_id || '.xml' AS filename,
      round_even(strlen(html) / 1024.0, 2) AS size_kb FROM pages WHERE regexp_matches(html, '^\\s*<')""",
)
def a1(spark, sf_dir):
    docs = page_docs(spark, sf_dir)
    return docs.filter(documents.looks_like_xml(F.col("content"))).select("subdir", "filename", "size_kb")


@registry.add(
    "a1_sniff",
    """SELECT doc_id AS id, false AS is_xml FROM documents WHERE NOT starts_with(ltrim(text), '<')
    UNION ALL SELECT doc_id, true FROM documents WHERE starts_with(ltrim(text), '<')""",
)
def a1_sniff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), documents.looks_like_xml(F.col("text").cast("binary")).alias("is_xml"))


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ZIP per text: the text as XML, a note, a member that is no XML, and two with unsafe names.

    Every 10th is damaged, every 10th after that declares too much.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            contents = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as archive:
                    archive.writestr(f"sub/d{doc_id}.XML", f"<d>{len(text)}</d>")
                    archive.writestr("note.txt", "<x/>")
                    archive.writestr("fake.xml", "no markup")
                    archive.writestr("../up.xml", "<x/>")
                    archive.writestr("/top.xml", "<x/>")
                    if doc_id % 10 == 2:
                        archive.writestr("large.bin", b"0" * 5000)
                contents.append(data.getvalue()[:-30] if doc_id % 10 == 1 else data.getvalue())
            yield pd.DataFrame({"path": [f"a{i}.zip" for i in frame["doc_id"]], "content": contents})

    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return texts.mapInPandas(pack, "path string, content binary")


@registry.add(
    "a2_expand_archives",
    """SELECT 'a' || doc_id || '.zip' AS archive,
      CASE doc_id % 10 WHEN 1 THEN 'bad archive' WHEN 2 THEN 'too large' END AS archive_error,
      CASE WHEN doc_id % 10 NOT IN (1, 2) THEN 'sub/d' || doc_id || '.XML' END AS path,
      CASE WHEN doc_id % 10 NOT IN (1, 2) THEN '<d>' || len(text) || '</d>' END AS xml FROM documents""",
)
def a2(spark, sf_dir):
    members = documents.expand_archives(_archives(spark, sf_dir), max_bytes=4096)
    return members.withColumn("xml", F.col("content").cast("string")).drop("content")


@registry.add(
    "a3_intake_report",
    """SELECT 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '.XML' WHEN 1 THEN '.xml' ELSE '.html' END AS path,
      round_even(strlen(html) / 1024.0, 2) AS size_kb,
      CASE WHEN strlen(html) > 6000 THEN 'too_large' WHEN page_id % 3 = 2 THEN 'ignored' ELSE 'accepted' END AS status FROM pages
    UNION ALL SELECT 't' || item_id || '.xml', round_even(strlen(text) / 1024.0, 2), 'not_xml' FROM benchmark""",
)
def a3(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr(
        "concat('p', page_id, CASE page_id % 3 WHEN 0 THEN '.XML' WHEN 1 THEN '.xml' ELSE '.html' END) AS path",
        "cast(html AS binary) AS content",
    )
    texts = table(spark, sf_dir, "benchmark").selectExpr("concat('t', item_id, '.xml') AS path", "cast(text AS binary) AS content")
    return documents.intake_report(pages.unionByName(texts), max_bytes=6000)


@registry.add(
    "a3_intake_totals",
    """SELECT CASE doc_id % 10 WHEN 1 THEN 'bad_archive' ELSE 'accepted' END AS status, count(*) AS files
    FROM documents GROUP BY 1""",
)
def a3_totals(spark, sf_dir):
    return documents.intake_totals(documents.intake_report(_archives(spark, sf_dir)))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        """concat(CASE WHEN doc_id % 50 = 0 THEN '' ELSE concat('Texte/', source, '/', lang, '/') END,
        CASE WHEN doc_id % 9 = 0 THEN '.' ELSE '' END, 'd', doc_id, CASE WHEN doc_id % 4 = 0 THEN '.XML' WHEN doc_id % 4 = 1
        THEN '.txt' ELSE '.xml' END) AS path""",
        "n_chars AS length",
    )


_INDEX_SQL = """WITH f AS (
  SELECT CASE WHEN doc_id % 50 = 0 THEN '' ELSE 'Texte/' || source || '/' || lang || '/' END AS dir,
    CASE WHEN doc_id % 9 = 0 THEN '.' ELSE '' END || 'd' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '.XML'
      WHEN doc_id % 4 = 1 THEN '.txt' ELSE '.xml' END AS name, n_chars,
    doc_id % 4 <> 1 AND doc_id % 9 <> 0 AS is_xml, source, lang FROM documents),
d AS (
  SELECT unnest(['Texte', 'Texte/' || source, 'Texte/' || source || '/' || lang]) AS path, is_xml FROM f WHERE dir <> ''),
ix AS (
  SELECT path, string_split(path, '/')[-1] AS name, true AS is_dir,
    CAST(len(string_split(path, '/')) - 1 AS BIGINT) AS depth, count(*) FILTER (is_xml) AS file_count,
    CAST(NULL AS DOUBLE) AS size_kb FROM d GROUP BY path
  UNION ALL SELECT dir || name, name, false, 3, NULL, round_even(n_chars / 1024.0, 2) FROM f WHERE dir <> '' AND name[1] <> '.')"""


@registry.add("a4_directory_index", f"{_INDEX_SQL} SELECT * FROM ix")
def a4(spark, sf_dir):
    return index.directory_index(_listing(spark, sf_dir))


@registry.add("a4_json_index", f"{_INDEX_SQL} SELECT * FROM ix")
def a4_json(spark, sf_dir):
    """The index written as JSON and read back whole."""
    path = scratch_path(spark)
    index.write_index(index.directory_index(_listing(spark, sf_dir)), path)
    return index.read_index(spark, path)


@registry.add(
    "a4_json_directory",
    f"{_INDEX_SQL} SELECT * FROM ix WHERE path = 'Texte/src1' OR starts_with(path, 'Texte/src1/')",
)
def a4_json_directory(spark, sf_dir):
    """One directory of the written index, from its own files."""
    path = scratch_path(spark)
    index.write_index(index.directory_index(_listing(spark, sf_dir)), path)
    return index.read_index(spark, path, "Texte/src1")


@registry.add(
    "a5_index_order",
    f"""{_INDEX_SQL} SELECT path, array_to_string(list_transform(string_split(path, '/'), lambda p: lower(p)), '|') AS sort_key
    FROM ix""",
)
def a5(spark, sf_dir):
    rows = index.directory_index(_listing(spark, sf_dir))
    return rows.select("path", index.index_order().alias("sort_key")).orderBy("sort_key")


@registry.add(
    "a6_search_index",
    f"""{_INDEX_SQL}, hit AS (SELECT path FROM ix WHERE contains(lower(name), 'd1'))
    SELECT path, is_dir FROM ix WHERE EXISTS (SELECT 1 FROM hit h WHERE h.path = ix.path OR starts_with(h.path, ix.path || '/'))""",
)
def a6(spark, sf_dir):
    return index.search_index(index.directory_index(_listing(spark, sf_dir)), "D1").select("path", "is_dir")


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.directory_index(_listing(spark, sf_dir))
    chosen = rows.filter(F.col("path").isin("Texte/src1", "Texte/src2", "Texte/src3/de"))
    dropped = rows.filter(F.col("path") == "Texte/src2/en")
    return index.select_paths(rows, chosen, dropped)


_SELECTED = """(path IN ('Texte/src1', 'Texte/src2', 'Texte/src3/de') OR starts_with(path, 'Texte/src1/')
  OR starts_with(path, 'Texte/src2/') OR starts_with(path, 'Texte/src3/de/'))
  AND path <> 'Texte/src2/en' AND NOT starts_with(path, 'Texte/src2/en/')"""


@registry.add("a7_select_paths", f"{_INDEX_SQL} SELECT path, is_dir FROM ix WHERE {_SELECTED}")
def a7(spark, sf_dir):
    return _selection(spark, sf_dir).select("path", "is_dir")


@registry.add(
    "a8_selected_docs",
    f"""{_INDEX_SQL} SELECT path, regexp_extract(path, '^(.*)/', 1) AS subdir, name AS filename, size_kb FROM ix
    WHERE NOT is_dir AND lower(path) LIKE '%.xml' AND {_SELECTED}""",
)
def a8(spark, sf_dir):
    return index.selected_docs(_selection(spark, sf_dir))


@registry.add(
    "a9_source_label",
    """SELECT 'c' || c_custkey || '.xml' AS filename, CASE c_custkey % 5 WHEN 0 THEN 'BWB Bd. ' || c_nationkey || ', H. ?'
      WHEN 1 THEN 'BWB Bd. ?, H. ' || c_nationkey WHEN 2 THEN 'BWB Bd. 1, H. 2' ELSE '' END AS quelle FROM customer""",
)
def a9(spark, sf_dir):
    xml = F.expr(
        """CASE c_custkey % 5
        WHEN 0 THEN concat('<artikel wb="bwb" band="', c_nationkey, '"/>')
        WHEN 1 THEN concat('<bdo><artikel heft="', c_nationkey, '" wb="BWB"/></bdo>')
        WHEN 2 THEN '<bdo><!-- x --><a/><artikel wb="Bwb" band="1" heft="2"/></bdo>'
        WHEN 3 THEN '<bdo><!-- x --><a/><b/><artikel wb="bwb" band="1" heft="2"/></bdo>'
        ELSE '<bdo><a><artikel wb="bwb"/></a><artikel wb="dwb"/></bdo>' END"""
    )
    rows = spread(table(spark, sf_dir, "customer"), "c_custkey")
    docs = documents.docs_from_table(rows, F.expr("concat('c', c_custkey, '.xml')"), xml, F.col("c_custkey"))
    return Corpus.of(docs, [*DOC_KEYS, "node_id"]).nodes.filter("node_id = 0").select("filename", "quelle")


@registry.add(
    "j_source_key",
    """SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(lower(p_brand || ' (' || p_name || ')'), '[^a-z0-9_]', '_', 'g'),
      '_+', '_', 'g'), '_') AS key FROM part""",
)
def j_key(spark, sf_dir):
    name = F.concat("p_brand", F.lit(" ("), "p_name", F.lit(")"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), source_key(name).alias("key"))


@registry.add(
    "a1_scan_corpus",
    """SELECT 'part=' || (doc_id // 100) AS subdir, CAST(count(*) + 1 AS BIGINT) AS elements, sum(doc_id) AS ids,
      CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines
    FROM documents GROUP BY ALL""",
)
def a1_scan(spark, sf_dir):
    """Files of the whole texts of a hundred ids each are written, scanned as a corpus, and shredded."""
    folder, text = scratch_path(spark), escaped("text")
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id div 100 AS part", "doc_id AS place", f"concat('<d id=\"', doc_id, '\">', {text}, '</d>') AS line"
    )
    ends = rows.select("part").distinct().selectExpr("part", "explode(array(struct(-1L AS place, '<c>' AS line), struct(9223372036854775807L AS place, '</c>' AS line))) AS e")
    lines = rows.unionByName(ends.selectExpr("part", "e.place", "e.line"))
    lines.repartition("part").sortWithinPartitions("part", "place").select("part", "line").write.partitionBy("part").text(folder)
    nodes = Corpus.of(documents.scan_corpus(spark, folder, "part-*.txt"), [*DOC_KEYS, "attrs", "text"]).nodes
    text_of = F.when(F.size("attrs") > 0, F.coalesce("text", F.lit("")))  # of a document, not the root
    values = nodes.select("subdir", F.get("attrs", 0)["value"].cast("long").alias("id"), text_of.alias("text"))
    return values.groupBy("subdir").agg(
        F.count(F.lit(1)).alias("elements"), F.sum("id").alias("ids"), F.sum(F.length("text")).alias("chars"),
        F.sum(F.size(F.split("text", "\n"))).alias("lines"),
    )
