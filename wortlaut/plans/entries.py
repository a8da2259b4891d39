"""Registered queries over dictionary articles: search, uniqueness, nesting, statistics, structure, conformance."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wortlaut.functions.sizes import scratch_path
from wortlaut.operators import nesting, schema_check, search, structure, unique, validate
from wortlaut.operators.corpus import DOC_KEYS, Corpus
from wortlaut.operators.grammar import compile_grammar
from wortlaut.operators.split_shred import shred_entries
from wortlaut.plans.common import (
    ENTRY_GRAMMAR,
    ENTRY_SOURCE_SQL,
    ENTRY_SQL,
    Registry,
    entry_docs,
    table,
)
from wortlaut.sources.documents import docs_from_table

registry = Registry()
_KEYS = [*DOC_KEYS, "node_id", "tag", "line"]


def _corpus(spark: SparkSession, sf_dir: str, *columns: str) -> Corpus:
    return Corpus.of(entry_docs(spark, sf_dir), [*_KEYS, *columns])


def _hits(condition: str, columns: str) -> str:
    return f"{ENTRY_SQL} SELECT {ENTRY_SOURCE_SQL}, CAST(line AS BIGINT) AS line, {columns} FROM el WHERE {condition}"


_PATH = "path AS full_path, coalesce(text, '') AS text_content"


@registry.add("c1_tag_search", _hits("tag = 'sense'", _PATH))
def c1(spark, sf_dir):
    return search.find_path(_corpus(spark, sf_dir, "path", "text").nodes, " Sense")


@registry.add("c2_child_path", _hits("path LIKE '%/sense/sense'", _PATH))
def c2(spark, sf_dir):
    return search.find_path(_corpus(spark, sf_dir, "path", "text").nodes, "sense/sense")


@registry.add("c3_wildcard_path", _hits("path LIKE 'entry/%/%def'", _PATH))
def c3(spark, sf_dir):
    return search.find_path(_corpus(spark, sf_dir, "path", "text").nodes, "entry/*/def")


@registry.add(
    "c4_child_pattern",
    _hits(
        "path LIKE '%/sense/sense/sense' OR path LIKE '%/sense/cit/sense'",
        "CAST(NULL AS BIGINT) AS depth, '<sense>' AS details",
    ),
)
def c4(spark, sf_dir):
    return search.find_pattern(_corpus(spark, sf_dir, "path").nodes, "sense/ * /sense")


@registry.add("c7_hit_count", f"{ENTRY_SQL} SELECT count(*) AS hits FROM el WHERE path LIKE '%form/orth'")
def c7(spark, sf_dir):
    found = search.find_path(_corpus(spark, sf_dir, "path", "text").nodes, "form/orth")
    return found.agg(F.count(F.lit(1)).alias("hits"))


def _unique(key: str, where: str, message: str, details: str, source: str = "el") -> str:
    return f"""{ENTRY_SQL}, g AS (
      SELECT k, {key}, count(*) AS n, min(pos) AS pos, arg_min(line, pos) AS line,
        string_agg(CAST(line AS VARCHAR), ', ' ORDER BY pos) AS lines,
        string_agg(tag || ':' || line, ', ' ORDER BY pos) AS places
      FROM {source} WHERE {where} GROUP BY ALL HAVING count(*) > 1)
    SELECT {ENTRY_SOURCE_SQL}, CAST(line AS BIGINT) AS line, {message} AS error_type, {details} AS details FROM g"""


@registry.add(
    "d1_tag_once",
    _unique("tag", "tag = 'def'", "'Tag ''def'' kommt ' || n || 'x vor'", "'Erwartet: 1x, Gefunden: ' || n || 'x'"),
)
def d1(spark, sf_dir):
    return unique.dup_tags(_corpus(spark, sf_dir).nodes, "def")


@registry.add(
    "d2_content_unique",
    _unique(
        "text", "tag = 'def'", "'Inhalt ''' || text || ''' in Tag ''def'' kommt ' || n || 'x vor'",
        "'Zeilen: ' || lines",
    ),
)
def d2(spark, sf_dir):
    return unique.dup_contents(_corpus(spark, sf_dir, "text").nodes, "def")


@registry.add(
    "d3_attr_unique_in_tag",
    _unique(
        "value", "tag = 'sense' AND attr = 'src'",
        "'Attribut ''src'' mit Wert ''' || value || ''' in Tag ''sense'' kommt ' || n || 'x vor'",
        "'Zeilen: ' || lines", "att",
    ),
)
def d3(spark, sf_dir):
    return unique.dup_attr_in_tag(_corpus(spark, sf_dir, "attrs").nodes, "sense", "src")


@registry.add(
    "d4_attr_unique",
    _unique(
        "value", "attr = 'n'", "'Attribut ''n'' mit Wert ''' || value || ''' kommt ' || n || 'x vor'",
        "'In: ' || places", "att",
    ),
)
def d4(spark, sf_dir):
    return unique.dup_attr(_corpus(spark, sf_dir, "attrs").nodes, "n")


@registry.add(
    "d5_xml_id",
    f"{ENTRY_SQL} SELECT {ENTRY_SOURCE_SQL}, value AS xml_id, CAST(NULL AS VARCHAR) AS plain_id FROM att WHERE attr = 'id'",
)
def d5(spark, sf_dir):
    from wortlaut.functions.attrs import attr_value

    roots = _corpus(spark, sf_dir, "attrs").nodes.filter("node_id = 0")
    return roots.select(
        "quelle", "subdir", "filename", attr_value("xml:id").alias("xml_id"), attr_value("id").alias("plain_id")
    )


@registry.add("e1_tag_inventory", f"{ENTRY_SQL} SELECT DISTINCT tag FROM el")
def e1(spark, sf_dir):
    return search.tag_inventory(_corpus(spark, sf_dir).nodes)


@registry.add(
    "e7_tag_exists",
    f"""{ENTRY_SQL} SELECT 'cit' AS tag, max(tag = 'cit') AS tag_exists FROM el
    UNION ALL SELECT 'verse', max(tag = 'verse') FROM el""",
)
def e7(spark, sf_dir):
    nodes = _corpus(spark, sf_dir).nodes
    parts = [search.tag_exists(nodes, t).select(F.lit(t).alias("tag"), "tag_exists") for t in ("cit", "verse")]
    return parts[0].unionByName(parts[1])


@registry.add(
    "e8_include_exclude",
    f"""{ENTRY_SQL} SELECT DISTINCT tag, tag NOT IN ('orth', 'form') AS included FROM el""",
)
def e8(spark, sf_dir):
    tags = search.tag_inventory(_corpus(spark, sf_dir).nodes).withColumn("included", F.lit(True))
    return search.include_tags(search.exclude_tags(tags, "orth", "form", "def"), "def")


@registry.add(
    "e9_nesting_direct",
    _hits(
        "path LIKE '%/sense/sense'",
        """CAST(CASE WHEN path LIKE '%/sense/sense/sense' THEN 3 ELSE 2 END AS BIGINT) AS depth,
        CASE WHEN path LIKE '%/sense/sense/sense' THEN 'sense > sense > sense' ELSE 'sense > sense' END AS details""",
    ),
)
def e9(spark, sf_dir):
    return nesting.nesting(_corpus(spark, sf_dir, "path").nodes, "sense")


@registry.add(
    "e10_nesting_any",
    _hits(
        "tag = 'sense' AND path LIKE '%/sense/%sense'",
        """CAST(len(path) - len(replace(path, 'sense', 'sens')) AS BIGINT) AS depth,
        replace(substr(path, position('sense' IN path)), '/', ' > ') AS details""",
    ),
)
def e10(spark, sf_dir):
    return nesting.nesting(_corpus(spark, sf_dir, "path").nodes, "sense", direct=False)


@registry.add(
    "e11_tag_stats",
    f"""{ENTRY_SQL}, lens AS (
      SELECT k, len(d) + CASE WHEN v = 1 THEN 4 ELSE 0 END AS n FROM s
      UNION ALL SELECT k, CASE WHEN v = 1 THEN 4 ELSE 0 END FROM s WHERE v > 0
      UNION ALL SELECT k, 0 FROM s WHERE v = 3)
    SELECT {ENTRY_SOURCE_SQL}, count(n) AS count, min(n) AS min_length, max(n) AS max_length,
      CAST(printf('%.1f', sum(n)::DOUBLE / nullif(count(n), 0)) AS DOUBLE) AS avg_length
    FROM o LEFT JOIN lens USING (k) GROUP BY k""",
)
def e11(spark, sf_dir):
    return nesting.tag_stats(_corpus(spark, sf_dir, "string_len").nodes, "sense")


# Structure.  The tree is computed from el, ranks and depth-first keys included.
_TREE_SQL = f"""{ENTRY_SQL}, tree AS (
  SELECT path, parent_path, tag, depth, has_text,
    row_number() OVER (PARTITION BY parent_path ORDER BY CASE WHEN depth = 0 THEN path END, first_seen) AS child_rank
  FROM (
    SELECT path, array_to_string(string_split(path, '/')[:-2], '/') AS parent_path, any_value(tag) AS tag,
      len(string_split(path, '/')) - 1 AS depth, max(coalesce(text, '') <> '') AS has_text,
      min(k * 100 + pos) AS first_seen
    FROM el GROUP BY path)),
keys AS (
  SELECT t.path, string_agg(lpad(CAST(a.child_rank AS VARCHAR), 9, '0'), '.2' ORDER BY a.depth) AS sort_key
  FROM tree t JOIN tree a ON t.path = a.path OR starts_with(t.path, a.path || '/') GROUP BY t.path),
vals AS (
  SELECT path, attr, string_agg(value, '|' ORDER BY seen) AS attr_values, count(*) AS n,
    string_agg(value, '|' ORDER BY seen) FILTER (rank <= 5) AS inline_attr_values
  FROM (
    SELECT *, row_number() OVER (PARTITION BY path, attr ORDER BY seen) AS rank
    FROM (SELECT path, attr, value, min(k * 100 + pos) AS seen FROM att GROUP BY path, attr, value))
  WHERE rank <= 20 GROUP BY path, attr),
rws AS (
  SELECT t.path AS id, t.path, depth, 'tag' AS kind, tag AS label,
    has_text OR EXISTS (SELECT 1 FROM vals v WHERE v.path = t.path)
      OR EXISTS (SELECT 1 FROM tree u WHERE u.parent_path = t.path) AS has_children,
    '' AS attr_values, '' AS inline_attr_values, 0 AS extra_attr_count, sort_key
  FROM tree t JOIN keys USING (path)
  UNION ALL SELECT path || '/@' || attr, path, depth + 1, 'attr', '@' || attr, false, attr_values, inline_attr_values,
    greatest(0, n - 5), sort_key || '.0' || attr
  FROM vals JOIN tree USING (path) JOIN keys USING (path)
  UNION ALL SELECT path || '/#text', path, depth + 1, 'text_content', '#text', false, '', '', 0, sort_key || '.1'
  FROM tree JOIN keys USING (path) WHERE has_text)
"""


def _structure(spark: SparkSession, sf_dir: str) -> Corpus:
    return _corpus(spark, sf_dir, "path", "text", "attrs", "first_in_doc")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.tree_rows(_structure(spark, sf_dir).nodes)


_ROW = ("id", "depth", "kind", "label", "has_children", "attr_values", "inline_attr_values", "extra_attr_count", "sort_key")
_ROW_SQL = """id, CAST(depth AS BIGINT) AS depth, kind, label, has_children, attr_values, inline_attr_values,
  CAST(extra_attr_count AS BIGINT) AS extra_attr_count, sort_key"""


@registry.add(
    "f1_path_tree",
    f"""{_TREE_SQL} SELECT path, parent_path, tag, CAST(depth AS BIGINT) AS depth, has_text,
    CAST(child_rank AS BIGINT) AS child_rank FROM tree""",
)
def f1(spark, sf_dir):
    return structure.path_tree(_corpus(spark, sf_dir, "path", "text", "first_in_doc").nodes)


@registry.add("f3_attr_values", f"{_TREE_SQL} SELECT path, attr, attr_values FROM vals")
def f3(spark, sf_dir):
    return structure.path_attrs(_corpus(spark, sf_dir, "path", "attrs").nodes)


@registry.add(
    "f4_text_samples",
    f"""{ENTRY_SQL}, g AS (SELECT path, text, min(k * 100 + pos) AS seen FROM el WHERE text <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen) AS n FROM g)
    SELECT path, string_agg(text, '|' ORDER BY n) AS text_examples FROM r WHERE n <= 5 GROUP BY path""",
)
def f4(spark, sf_dir):
    return structure.path_texts(_corpus(spark, sf_dir, "path", "text").nodes)


@registry.add("f5_tree_rows", f"{_TREE_SQL} SELECT {_ROW_SQL} FROM rws")
def f5(spark, sf_dir):
    return _tree(spark, sf_dir).select(*_ROW)


@registry.add(
    "f6_visible_rows",
    f"""{_TREE_SQL}, closed AS (SELECT id FROM rws WHERE kind = 'tag' AND has_children AND depth >= 1)
    SELECT id, kind, id IN (SELECT id FROM closed) AS is_collapsed FROM rws r
    WHERE NOT EXISTS (SELECT 1 FROM closed c WHERE starts_with(r.id, c.id || '/'))""",
)
def f6(spark, sf_dir):
    return structure.visible_rows(structure.default_collapse(_tree(spark, sf_dir))).select("id", "kind", "is_collapsed")


@registry.add(
    "f6_set_visibility",
    f"""{_TREE_SQL} SELECT id, id = 'entry/sense' AS is_collapsed, NOT starts_with(id, 'entry/sense/') AS is_visible
    FROM rws""",
)
def f6_set(spark, sf_dir):
    rows = _tree(spark, sf_dir)
    closed = rows.filter("kind = 'tag' AND label = 'sense' AND depth = 1 AND path LIKE 'entry%'").select("id")
    return structure.set_visibility(rows, closed).select("id", "is_collapsed", "is_visible")


@registry.add(
    "f7_tree_search",
    f"""{_TREE_SQL}, hit AS (
      SELECT id, path FROM rws WHERE contains(lower(label), 'cit')
        OR len(list_filter(string_split(inline_attr_values, '|'), lambda x: contains(lower(x), 'cit'))) > 0)
    SELECT id, id IN (SELECT id FROM hit) AS is_search_match FROM rws r
    WHERE EXISTS (SELECT 1 FROM hit h WHERE h.path = r.path OR starts_with(h.path, r.path || '/'))""",
)
def f7(spark, sf_dir):
    found = structure.search_tree(_tree(spark, sf_dir), " CIT ")
    return found.select("id", "is_search_match")


_DOC = "entries/s7/o7.xml"


@registry.add(
    "f8_project_doc",
    f"""{_TREE_SQL}, own AS (
      SELECT path || '/@' || attr AS id, string_agg(value, '|' ORDER BY seen) AS v, count(*) AS n
      FROM (SELECT path, attr, value, min(pos) AS seen FROM att WHERE k = 7 GROUP BY ALL) GROUP BY path, attr),
    txt AS (SELECT path || '/#text' AS id, arg_min(text, pos) AS t FROM el WHERE k = 7 AND text <> '' GROUP BY path)
    SELECT id, attr_values, coalesce(v, '') AS inline_attr_values,
      CASE kind WHEN 'text_content' THEN coalesce(t, '...') ELSE '' END AS example_value,
      CASE kind WHEN 'attr' THEN v IS NOT NULL WHEN 'text_content' THEN t IS NOT NULL ELSE false END AS has_content
    FROM rws LEFT JOIN own USING (id) LEFT JOIN txt USING (id)""",
)
def f8(spark, sf_dir):
    corpus = _structure(spark, sf_dir)
    shown = structure.project_doc(structure.tree_rows(corpus.nodes), corpus.document(_DOC).nodes)
    return shown.select("id", "attr_values", "inline_attr_values", "example_value", "has_content")


@registry.add("f9_all_docs", f"{_TREE_SQL} SELECT {_ROW_SQL} FROM rws")
def f9(spark, sf_dir):
    corpus = _structure(spark, sf_dir)
    one = structure.project_doc(structure.tree_rows(corpus.nodes), corpus.document(_DOC).nodes)
    return structure.all_docs(one).select(*_ROW)


@registry.add(
    "f10_next_example",
    f"""{ENTRY_SQL} SELECT 'entries/s' || (k % 20) || '/o' || k || '.xml' AS document, text AS example
    FROM el WHERE path LIKE '%/sense/def' AND text <> 'sense of O' ORDER BY k, pos LIMIT 1""",
)
def f10(spark, sf_dir):
    nodes = _corpus(spark, sf_dir, "path", "text").nodes
    found = structure.find_example(nodes, "sense/def", exclude="sense of O")
    return found.select(F.col("doc_id").alias("document"), "example")


@registry.add(
    "f11_attr_row_values",
    f"""{_TREE_SQL} SELECT CAST(n - 1 AS BIGINT) AS no, value FROM (
      SELECT unnest(string_split(attr_values, '|')) AS value, generate_subscripts(string_split(attr_values, '|'), 1) AS n
      FROM vals WHERE path = 'entry/sense' AND attr = 'src')""",
)
def f11(spark, sf_dir):
    return structure.attr_row_values(_tree(spark, sf_dir), "entry/sense/@src")


# The node table itself.
@registry.add(
    "a17_nodes",
    f"""{ENTRY_SQL}, anc AS (SELECT *, string_split(path, '/') AS steps FROM el)
    SELECT 'entries/s' || (k % 20) || '/o' || k || '.xml' AS document, path, tag, CAST(len(steps) - 1 AS BIGINT) AS depth,
      CASE WHEN len(steps) > 1 THEN steps[-2] END AS parent_tag, CAST(line AS BIGINT) AS line,
      row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS number,
      CASE WHEN len(steps) = 1 THEN chr(10) ELSE text END AS text,
      row_number() OVER (PARTITION BY k, path ORDER BY pos) = 1 AS first_in_doc FROM anc""",
)
def a17(spark, sf_dir):
    nodes = _corpus(spark, sf_dir, "path", "depth", "parent_tag", "text", "first_in_doc").nodes
    return nodes.select(
        F.col("doc_id").alias("document"), "path", "tag", "depth", "parent_tag", "line",
        F.col("node_id").alias("number"), "text", "first_in_doc",
    )


@registry.add(
    "a17_entry_splits",
    f"""{ENTRY_SQL}, before AS (
      SELECT k, k // 100000 AS file, 1 + coalesce(sum(3 + c % 4) OVER (PARTITION BY k // 100000 ORDER BY k
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lines FROM o),
    inside AS (SELECT file, k, pos, 'entries/' || path AS path, tag, lines + line AS line FROM el JOIN before USING (k)
      UNION ALL SELECT DISTINCT file, -1, 0, 'entries', 'entries', 1 FROM before)
    SELECT 'file=' || file AS document, path, tag, CAST(len(string_split(path, '/')) - 1 AS BIGINT) AS depth,
      CAST(line AS BIGINT) AS line, row_number() OVER (PARTITION BY file ORDER BY k, pos) - 1 AS number,
      row_number() OVER (PARTITION BY file, path ORDER BY k, pos) = 1 AS first_in_doc FROM inside""",
)
def a17_splits(spark, sf_dir):
    """All articles in large files, 100,000 keys each, which are read in splits."""
    rows = entry_docs(spark, sf_dir).select(
        F.floor(F.col("doc_ord") / 100_000).alias("file"), F.col("doc_ord").alias("k"), F.col("content").cast("string").alias("xml")
    )
    files = rows.select("file").distinct()
    edges = F.array(
        F.struct(F.lit(-1).cast("long").alias("k"), F.lit('<entries xmlns="urn:example:entries">').alias("xml")),
        F.struct(F.lit(2**62).alias("k"), F.lit("</entries>").alias("xml")),
    )
    lines = rows.unionByName(files.select("file", F.inline(edges)))
    path = scratch_path(spark)
    lines.repartition("file").sortWithinPartitions("file", "k").select("file", "xml").write.partitionBy("file").text(path)
    columns = ["subdir", "path", "tag", "depth", "line", "node_id", "first_in_doc"]
    nodes = shred_entries(spark, path, "entry", glob="*.txt", columns=columns).filter("kind = 'element'")
    return nodes.select(
        F.col("subdir").alias("document"), "path", "tag", "depth", "line", F.col("node_id").alias("number"), "first_in_doc"
    )


@registry.add(
    "a17_attributes",
    f"""{ENTRY_SQL} SELECT 'entries/s' || (k % 20) || '/o' || k || '.xml' AS document, path, attr, value,
      CASE WHEN attr IN ('id', 'lang') THEN '{{http://www.w3.org/XML/1998/namespace}}' || attr ELSE attr END AS name FROM att""",
)
def a17_attributes(spark, sf_dir):
    nodes = _corpus(spark, sf_dir, "path", "attrs").nodes
    rows = nodes.select(F.col("doc_id").alias("document"), "path", F.explode("attrs").alias("a"))
    return rows.select("document", "path", F.col("a.local").alias("attr"), "a.value", "a.name")


@registry.add(
    "a19_grid_page",
    f"""{ENTRY_SQL} SELECT {ENTRY_SOURCE_SQL}, CAST(line AS BIGINT) AS line, {_PATH} FROM el
    WHERE tag = 'def' AND line >= 4 ORDER BY line DESC, filename, path LIMIT 25 OFFSET 25""",
)
def a19(spark, sf_dir):
    """Sorting, filtering and paging of results is plain DataFrame work; a page has 25 rows."""
    found = search.find_path(_corpus(spark, sf_dir, "path", "text").nodes, "def").filter("line >= 4")
    return found.orderBy(F.desc("line"), "filename", "full_path").offset(25).limit(25)


# Validation.
@registry.add(
    "b1_wellformed",
    f"""{ENTRY_SQL} SELECT {ENTRY_SOURCE_SQL}, CAST(c % 4 + 3 AS BIGINT) AS line, CAST(3 AS BIGINT) AS "column",
    'mismatched tag' AS error FROM o WHERE k % 17 = 0""",
)
def b1(spark, sf_dir):
    corpus = Corpus.of(entry_docs(spark, sf_dir, broken=True), [*DOC_KEYS, "line", "column", "error"])
    return validate.check_wellformed(corpus.parse_errors)


_SCHEMA_COLUMNS = ("kind", "ns", "path", "depth", "parent_tag", "children", "text", "tail", "attrs")


@cache
def _grammar():
    return compile_grammar(ENTRY_GRAMMAR)


def _violations(*parts: str) -> str:
    union = " UNION ALL ".join(parts)
    return f"""{ENTRY_SQL}, bad AS ({union}) SELECT {ENTRY_SOURCE_SQL}, CAST(line AS BIGINT) AS line,
    CAST(0 AS BIGINT) AS "column", error FROM bad"""


_ROOT = "SELECT k, 1 AS line, 'root-not-allowed: item' AS error FROM o WHERE r = 'item'"
_ELEMENTS = "SELECT k, line, 'element-undeclared: ' || tag AS error FROM el WHERE tag IN ('item', 'note')"
_ALLOWED = "SELECT k, line, 'attribute-undeclared: form/@bogus' AS error FROM att WHERE attr = 'bogus'"
_REQUIRED = """SELECT k, 1 AS line, 'attribute-missing: entry/@{http://www.w3.org/XML/1998/namespace}lang' AS error
  FROM o WHERE r = 'entry' AND k % 6 = 0"""
_VALUES = """SELECT k, line, 'attribute-value: ' || tag || '/@' || attr || '=' || value AS error FROM att
  WHERE (tag = 'entry' AND attr = 'status' AND value = 'P') OR (attr = 'n' AND value = '9')
    OR (attr = 'src' AND value = 'c6')"""
_CHILDREN = "SELECT k, 2 AS line, 'child-not-allowed: entry/orth' AS error FROM o WHERE r = 'entry' AND k % 9 = 0"
_TEXT = "SELECT k, 2 AS line, 'text-not-allowed: entry' AS error FROM o WHERE r = 'entry' AND k % 13 = 0"
_MODEL = """SELECT k, 1 AS line, 'content-model: entry(form' || CASE WHEN k % 7 = 0 THEN ' note' ELSE '' END ||
    CASE WHEN k % 9 = 0 THEN ' orth' ELSE '' END || repeat(' sense', CAST(c % 4 AS INT)) || ')' AS error
  FROM o WHERE r = 'entry' AND (k % 7 = 0 OR k % 9 = 0 OR c % 4 = 0)"""


@registry.add(
    "b2_validation_summary",
    f"""{ENTRY_SQL}, bad AS ({" UNION ALL ".join([_ROOT, _ELEMENTS, _ALLOWED, _REQUIRED, _VALUES, _CHILDREN, _TEXT, _MODEL])}),
    schema_bad AS (SELECT * FROM bad WHERE k % 17 <> 0)
    SELECT (SELECT count(*) FROM o) AS files_checked,
      (SELECT count(*) FROM o WHERE k % 17 = 0) AS files_with_wellformed_errors,
      (SELECT count(*) FROM o WHERE k % 17 = 0) AS wellformed_errors,
      (SELECT count(DISTINCT k) FROM schema_bad) AS files_with_schema_errors,
      (SELECT count(*) FROM schema_bad) AS schema_errors""",
)
def b2(spark, sf_dir):
    corpus = Corpus.of(entry_docs(spark, sf_dir, broken=True), [*_KEYS, *_SCHEMA_COLUMNS])
    return schema_check.schema_summary(corpus.shredded, _grammar())


def _schema(name: str, check, *parts: str) -> None:
    @registry.add(name, _violations(*parts))
    def query(spark, sf_dir):
        return check(_corpus(spark, sf_dir, *_SCHEMA_COLUMNS).shredded, _grammar())


_schema("b3_schema", schema_check.check_schema, _ROOT, _ELEMENTS, _ALLOWED, _REQUIRED, _VALUES, _CHILDREN, _TEXT, _MODEL)
_schema("b4_root", schema_check.check_root, _ROOT)
_schema("b5_elements", schema_check.check_elements, _ELEMENTS)
_schema("b6_attrs_allowed", schema_check.check_attrs_allowed, _ALLOWED)
_schema("b7_attrs_required", schema_check.check_attrs_required, _REQUIRED)
_schema("b8_attr_values", schema_check.check_attr_values, _VALUES)
_schema("b9_children", schema_check.check_children, _CHILDREN)
_schema("b10_text_allowed", schema_check.check_text_allowed, _TEXT)
_schema("b11_content_model", schema_check.check_content_model, _MODEL)


# A grammar of a hundred elements, made by rule: g0 … g99, each with an attribute of its own range and two kinds of
# children.  Articles from three tables, each a root and a child.
_TAGS = 100


@cache
def _large_grammar():
    start = "".join(f'<ref name="g{i}"/>' for i in range(_TAGS))
    defines = "".join(
        f"""<define name="g{i}"><element name="g{i}">
          <attribute name="k"><data type="nonNegativeInteger"><param name="maxInclusive">{5 * i}</param></data></attribute>
          <optional><attribute name="v{i % 9}"><choice><value>a{i}</value><value>b</value></choice></attribute></optional>
          <zeroOrMore><choice><ref name="g{(i + 1) % _TAGS}"/><ref name="g{i * 7 % _TAGS}"/></choice></zeroOrMore>
        </element></define>"""
        for i in range(_TAGS)
    )
    return compile_grammar(
        f"""<grammar xmlns="http://relaxng.org/ns/structure/1.0" ns="urn:example:large"
        datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes"><start><choice>{start}</choice></start>{defines}</grammar>"""
    )


_LARGE_TABLES = (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey"), ("part", "p_partkey", "p_size"))


def _large_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = None
    for name, key, other in _LARGE_TABLES:
        one = table(spark, sf_dir, name).selectExpr(f"'{name}' AS t", f"cast({key} AS long) AS k", f"cast({other} AS long) AS o")
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.selectExpr("t", "k", "k % 100 AS a", "o * 7 % 100 AS b", "k * 3 % 600 AS v", "o")
    xml = """concat('<g', a, ' xmlns="urn:example:large" k="', v, '"', if(k % 4 = 0, concat(' v', a % 9, '="a', b, '"'), ''),
      if(k % 11 = 0, ' z="1"', ''), '>\n<g', b, if(k % 3 = 0, '', ' k="0"'), '/>', if(k % 13 = 0, 'x', ''), '</g', a, '>')"""
    return docs_from_table(rows, F.expr("concat(t, '/', k, '.xml')"), F.expr(xml), F.expr("k"))


_LARGE_SQL = f"""WITH r AS ({" UNION ALL ".join(f"SELECT '{t}' AS t, {k} AS k, {o} AS o FROM {t}" for t, k, o in _LARGE_TABLES)}),
x AS (SELECT t, k, k % 100 AS a, o * 7 % 100 AS b, k * 3 % 600 AS v FROM r),
bad AS (
  SELECT *, 1 AS line, 'attribute-value: g' || a || '/@k=' || v AS error FROM x WHERE v > 5 * a
  UNION ALL SELECT *, 1, 'attribute-value: g' || a || '/@v' || (a % 9) || '=a' || b FROM x WHERE k % 4 = 0 AND a <> b
  UNION ALL SELECT *, 1, 'attribute-undeclared: g' || a || '/@z' FROM x WHERE k % 11 = 0
  UNION ALL SELECT *, 2, 'attribute-missing: g' || b || '/@k' FROM x WHERE k % 3 = 0
  UNION ALL SELECT *, 2, 'child-not-allowed: g' || a || '/g' || b FROM x WHERE b <> (a + 1) % 100 AND b <> a * 7 % 100
  UNION ALL SELECT *, 2, 'text-not-allowed: g' || a FROM x WHERE k % 13 = 0)"""


@registry.add(
    "b3_large_grammar",
    f"""{_LARGE_SQL} SELECT t AS subdir, k || '.xml' AS filename, CAST(line AS BIGINT) AS line, error FROM bad""",
)
def b3_large(spark, sf_dir):
    corpus = Corpus.of(_large_docs(spark, sf_dir), [*_KEYS, *_SCHEMA_COLUMNS])
    return schema_check.check_schema(corpus.shredded, _large_grammar()).select("subdir", "filename", "line", "error")


# Senses of an article and senses below others have patterns of their own; what is interleaved; attributes that go together.
_TYPED_GRAMMAR = """<grammar xmlns="http://relaxng.org/ns/structure/1.0" ns="urn:example:entries"
    datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes">
  <start><ref name="entry"/></start>
  <define name="entry">
    <element name="entry">
      <attribute name="xml:id"/>
      <choice>
        <group><attribute name="xml:lang"/><attribute name="status"/></group>
        <attribute name="status"><value>O</value></attribute>
      </choice>
      <mixed><ref name="form"/><zeroOrMore><choice><ref name="note"/><ref name="orth"/></choice></zeroOrMore>
        <zeroOrMore><ref name="sense"/></zeroOrMore></mixed>
    </element>
  </define>
  <define name="form"><element name="form"><optional><attribute name="bogus"/></optional><ref name="orth"/></element></define>
  <define name="orth"><element name="orth"><text/></element></define>
  <define name="note"><element name="note"><empty/></element></define>
  <define name="sense">
    <element name="sense">
      <attribute name="n"><data type="nonNegativeInteger"><param name="maxInclusive">2</param></data></attribute>
      <attribute name="src"/>
      <interleave><ref name="def"/><oneOrMore><choice><ref name="cit"/><ref name="below"/></choice></oneOrMore></interleave>
    </element>
  </define>
  <define name="below">
    <element name="sense">
      <attribute name="n"><value>9</value></attribute>
      <optional><ref name="def"/></optional>
    </element>
  </define>
  <define name="def"><element name="def"><text/></element></define>
  <define name="cit"><element name="cit"><oneOrMore><ref name="below"/></oneOrMore></element></define>
</grammar>"""


@registry.add(
    "b3_typed_grammar",
    f"""{ENTRY_SQL}, bad AS (
      SELECT k, 1 AS line, 'root-not-allowed: item' AS error FROM o WHERE r = 'item'
      UNION ALL SELECT k, 1, 'element-undeclared: item' FROM o WHERE r = 'item'
      UNION ALL SELECT k, 1, 'attribute-choice: entry(@{{http://www.w3.org/XML/1998/namespace}}id @status)' FROM o
        WHERE r = 'entry' AND k % 6 = 0 AND st <> 'O'
      UNION ALL SELECT k, i + 2, 'attribute-value: sense/@n=3' FROM s WHERE r = 'entry' AND i = 3
      UNION ALL SELECT k, i + 2, 'content-model: sense(def)' FROM s WHERE r = 'entry' AND v = 0
      UNION ALL SELECT k, i + 2, 'attribute-value: sense/@n=8' FROM s WHERE v = 2
      UNION ALL SELECT k, i + 2, unnest(['child-not-allowed: sense/sense', 'content-model: sense(sense)'])
        FROM s WHERE r = 'entry' AND v = 3)
    SELECT {ENTRY_SOURCE_SQL}, CAST(line AS BIGINT) AS line, CAST(0 AS BIGINT) AS "column", error FROM bad""",
)
def b3_typed(spark, sf_dir):
    return schema_check.check_schema(_corpus(spark, sf_dir, *_SCHEMA_COLUMNS).shredded, _typed_grammar())


@cache
def _typed_grammar():
    return compile_grammar(_TYPED_GRAMMAR)
