"""Registered queries over running text: content search, text statistics, spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wortlaut.operators import nesting, search, spelling, unique
from wortlaut.operators.corpus import DOC_KEYS, SEGMENT_SOURCE, Corpus
from wortlaut.plans.common import ENTRY_SQL, Registry, entry_docs, table, text_docs, turn_docs
from wortlaut.sources.results import with_source_lines
from wortlaut.sources.wordlists import apply_tag_selection, tag_selection

registry = Registry()
_KEYS = [*DOC_KEYS, "node_id", "tag", "line"]

# The paragraphs of the text corpus and the turns of the conversation corpus, as rows.
_P_SQL = """WITH p AS (
  SELECT doc_id AS d, source, lang, generate_subscripts(string_split(text, chr(10)), 1) AS i,
    unnest(string_split(text, chr(10))) AS t FROM documents)"""
_P_SOURCE = "'' AS quelle, source || '/' || lang AS subdir, 'd' || d || '.xml' AS filename"
_T_SQL = """WITH t AS (
  SELECT conv_id AS c, turn AS n, text AS t,
    '<turn who="' || role || '" n="' || turn || '">' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</turn>' AS xml
  FROM conversations)"""
_T_SOURCE = "'' AS quelle, 'c' || c AS subdir, 't' || n || '.xml' AS filename"


def _shown(text: str) -> str:
    return f"""replace(replace(CASE WHEN len({text}) > 200 THEN substr({text}, 1, 200) || '...' ELSE {text} END,
      ' ', '·'), chr(10), '↵' || chr(10))"""


_COLLAPSED = "trim(regexp_replace(t, '\\s+', ' ', 'g'))"


def _turns(spark: SparkSession, sf_dir: str, *columns: str) -> Corpus:
    return Corpus.of(turn_docs(spark, sf_dir), [*_KEYS, *columns])


@registry.add(
    "e2_text_tags",
    f"""{ENTRY_SQL}, b AS (SELECT DISTINCT tag FROM el WHERE text <> ''
      UNION SELECT r FROM o WHERE k % 13 = 0) SELECT tag, tag <> 'orth' AS included FROM b""",
)
def e2(spark, sf_dir):
    segments = Corpus.of(entry_docs(spark, sf_dir), SEGMENT_SOURCE).segments
    return search.text_tags(segments, excluded=("orth", "titel"))


@registry.add(
    "e3_content_exact",
    f"""{_T_SQL} SELECT {_T_SOURCE}, CAST(1 AS BIGINT) AS line, 'turn' AS tag, {_shown('t')} AS text
    FROM t WHERE contains(t, '.' || chr(10))""",
)
def e3(spark, sf_dir):
    return search.search_content(_turns(spark, sf_dir, "text").nodes, ["turn"], ".\n")


@registry.add(
    "e4_content_normalised",
    f"""{_T_SQL} SELECT {_T_SOURCE}, CAST(1 AS BIGINT) AS line, 'turn' AS tag, {_shown(_COLLAPSED)} AS text
    FROM t WHERE contains({_COLLAPSED}, 'de la')""",
)
def e4(spark, sf_dir):
    return search.search_content(_turns(spark, sf_dir, "text").nodes, ["turn"], " de \n la ", normalise=True)


@registry.add(
    "e5_content_tags",
    f"""{ENTRY_SQL} SELECT '' AS quelle, 'entries/s' || (k % 20) AS subdir, 'o' || k || '.xml' AS filename,
    CAST(line AS BIGINT) AS line, tag, replace(text, ' ', '·') AS text FROM el WHERE tag IN ('orth', 'def') AND contains(text, 'x')""",
)
def e5(spark, sf_dir):
    nodes = Corpus.of(entry_docs(spark, sf_dir), [*_KEYS, "text"]).nodes
    tags = search.tag_inventory(nodes).filter(F.length("tag") >= 3).filter(F.col("tag").isin("orth", "def", "src"))
    return search.search_content(nodes, tags, "x")


@registry.add(
    "e6_visible_whitespace",
    f"SELECT doc_id AS id, {_shown('text')} AS shown FROM documents",
)
def e6(spark, sf_dir):
    from wortlaut.functions.text import show_whitespace

    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), show_whitespace(F.col("text")).alias("shown"))


@registry.add(
    "d2_repeated_paragraphs",
    f"""{_P_SQL}, g AS (SELECT d, source, lang, trim(t, ' ' || chr(9)) AS v, count(*) AS n, min(i + 1) AS line,
      string_agg(CAST(i + 1 AS VARCHAR), ', ' ORDER BY i) AS lines FROM p WHERE trim(t, ' ' || chr(9)) <> '' GROUP BY ALL HAVING count(*) > 1)
    SELECT {_P_SOURCE}, line, 'Inhalt ''' || CASE WHEN len(v) > 50 THEN substr(v, 1, 50) || '...' ELSE v END ||
      ''' in Tag ''p'' kommt ' || n || 'x vor' AS error_type, 'Zeilen: ' || lines AS details FROM g""",
)
def d2(spark, sf_dir):
    corpus = Corpus.of(text_docs(spark, sf_dir), [*_KEYS, "text"])
    return unique.dup_contents(corpus.nodes, "p")


@registry.add(
    "e11_text_stats",
    f"""{_P_SQL} SELECT {_P_SOURCE}, count(*) AS count, min(len(t)) AS min_length, max(len(t)) AS max_length,
      CAST(printf('%.1f', sum(len(t))::DOUBLE / count(*)) AS DOUBLE) AS avg_length FROM p GROUP BY d, source, lang""",
)
def e11(spark, sf_dir):
    return nesting.tag_stats(Corpus.of(text_docs(spark, sf_dir), [*_KEYS, "string_len"]).nodes, "p")


@registry.add(
    "a13_tag_selection",
    f"""{ENTRY_SQL}, t AS (SELECT DISTINCT tag FROM el)
    SELECT tag, CASE tag WHEN 'form' THEN 'nein' WHEN 'cit' THEN 'nein' ELSE 'ja' END AS inkludiert FROM t""",
)
def a13(spark, sf_dir):
    tags = search.tag_inventory(Corpus.of(entry_docs(spark, sf_dir), _KEYS).nodes)
    chosen = tags.selectExpr(
        "upper(tag) AS tag", "CASE tag WHEN 'form' THEN 'Nein' WHEN 'cit' THEN 'no' ELSE 'YES' END AS inkludiert"
    ).filter("tag <> 'DEF'")
    return tag_selection(apply_tag_selection(tags, chosen))


# Spelling.  The word list is made from the words of the benchmark table, with two entries of several pieces.
_WORD = "[\\p{L}\\p{N}_]+"
_LIST_SQL = f"""lst AS (
  SELECT DISTINCT w AS alt, w || '*' AS neu
  FROM (SELECT unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM benchmark) WHERE len(w) >= 6)"""


def _word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("alt"))
    return words.filter(F.length("alt") >= 6).distinct().withColumn("neu", F.concat("alt", F.lit("*")))


def _hits_sql(rows: str, keys: str) -> str:
    """Words of ``x`` that are in the list, with their offset and 40 characters on either side."""
    return f"""{rows}, cut AS (
      SELECT {keys}, replace(t, chr(10), ' ') AS x, regexp_extract_all(replace(t, chr(10), ' '), '{_WORD}') AS words,
        regexp_split_to_array(replace(t, chr(10), ' '), '{_WORD}') AS gaps FROM src),
    tok AS (SELECT *, generate_subscripts(words, 1) AS j, unnest(words) AS w FROM cut),
    {_LIST_SQL},
    hit AS (
      SELECT tok.*, neu, CAST(list_sum(list_transform(gaps[1:j], lambda g: len(g)))
        + coalesce(list_sum(list_transform(words[1:j - 1], lambda g: len(g))), 0) AS BIGINT) AS b
      FROM tok JOIN lst ON alt = w),
    kwic AS (
      SELECT {keys}, w AS gefunden, neu AS vorschlag, CASE WHEN b > 40 THEN '…' ELSE '' END ||
        trim(substr(x, greatest(0, b - 40) + 1, least(len(x), b + len(w) + 40) - greatest(0, b - 40))) ||
        CASE WHEN b + len(w) + 40 < len(x) THEN '…' ELSE '' END AS kontext FROM hit)"""


_P_ROWS = f"{_P_SQL}, src AS (SELECT * FROM p)"
_T_ROWS = f"{_T_SQL}, src AS (SELECT * FROM t)"


@registry.add(
    "h2_find_spellings",
    f"""{_hits_sql(_P_ROWS, 'd, source, lang, i')}
    SELECT {_P_SOURCE}, i + 1 AS hint_line, gefunden, vorschlag, kontext FROM kwic""",
)
def h2(spark, sf_dir):
    segments = Corpus.of(text_docs(spark, sf_dir), SEGMENT_SOURCE).segments
    hits = spelling.find_spellings(segments, _word_list(spark, sf_dir))
    return hits.select("quelle", "subdir", "filename", "hint_line", "gefunden", "vorschlag", "kontext")


@registry.add(
    "h2_find_spellings_joined",
    f"""{_hits_sql(_T_ROWS, 'c, n')} SELECT {_T_SOURCE}, gefunden, vorschlag, kontext FROM kwic""",
)
def h2_joined(spark, sf_dir):
    """The same over texts of many lines."""
    segments = Corpus.of(turn_docs(spark, sf_dir), SEGMENT_SOURCE).segments
    hits = spelling.find_spellings(segments, _word_list(spark, sf_dir))
    return hits.select("quelle", "subdir", "filename", "gefunden", "vorschlag", "kontext")


@registry.add(
    "h1_active_spellings",
    f"""WITH {_LIST_SQL}, custom AS (
      SELECT w AS alt, arg_max('c' || item_id, item_id) AS neu
      FROM (SELECT item_id, unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM benchmark)
      WHERE len(w) >= 8 GROUP BY w)
    SELECT alt, coalesce(custom.neu, lst.neu) AS neu FROM lst FULL JOIN custom USING (alt)""",
)
def h1(spark, sf_dir):
    builtin = _word_list(spark, sf_dir).withColumn("ord", F.lit(0))
    words = F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("alt")
    custom = (
        table(spark, sf_dir, "benchmark")
        .select(words, F.concat(F.lit("c"), "item_id").alias("neu"), F.col("item_id").alias("ord"))
        .filter(F.length("alt") >= 8)
    )
    return spelling.active_spellings(builtin, custom)


@registry.add(
    "h6_check_spelling",
    f"""{_hits_sql(_T_ROWS, 'c, n')}, ln AS (
      SELECT c, n, generate_subscripts(string_split(xml, chr(10)), 1) AS l, unnest(string_split(xml, chr(10))) AS s FROM t),
    places AS (SELECT c, n, gefunden, min(l) AS line FROM (SELECT DISTINCT c, n, gefunden FROM kwic) JOIN ln USING (c, n)
      WHERE contains(s, gefunden) GROUP BY ALL)
    SELECT {_T_SOURCE}, line, 'turn' AS tag, gefunden, vorschlag, kontext FROM kwic JOIN places USING (c, n, gefunden)""",
)
def h6(spark, sf_dir):
    corpus = Corpus.of(turn_docs(spark, sf_dir), SEGMENT_SOURCE)
    return spelling.check_spelling(corpus, _word_list(spark, sf_dir)).drop("seg_no", "place")


def _words_by(segments: DataFrame, *keys: str) -> DataFrame:
    """The different words of the segments with equal keys, in one array, so that words do not become rows."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))
    found = segments.select(*keys, words.alias("words"))
    return found.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))


@registry.add(
    "h5_exact_lines",
    f"""{_P_SQL}, ask AS (SELECT DISTINCT d, source, lang, i + 1 AS h, unnest(regexp_extract_all(t, '{_WORD}')) AS w FROM p)
    SELECT {_P_SOURCE}, h AS hint_line, w AS word, h AS line FROM ask""",
)
def h5(spark, sf_dir):
    """Every word, and the first source line from its paragraph's on that contains it: the paragraph stands on one line,
    so that is its own."""
    corpus = Corpus.of(text_docs(spark, sf_dir), SEGMENT_SOURCE)
    asked = _words_by(corpus.segments.filter("tag = 'p'"), *DOC_KEYS, "hint_line")
    return spelling.exact_lines(asked, corpus.docs).select("quelle", "subdir", "filename", "hint_line", "word", "line")


@registry.add(
    "h5_lines_further_down",
    f"""{_P_SQL}, ask AS (SELECT DISTINCT d, unnest(regexp_extract_all(t, '{_WORD}')) AS w FROM p),
    xml AS (SELECT doc_id AS d, source || '/' || lang || '/d' || doc_id || '.xml' AS document,
      '<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10), '</p>' || chr(10) || '<p>') || '</p>'
        || chr(10) || '</text>' AS x FROM documents),
    pre AS (SELECT document, w, substr(x, 1, instr(x, w)) AS s FROM ask JOIN xml USING (d))
    SELECT document, w AS word, CAST(2 + len(s) - len(replace(s, chr(10), '')) AS BIGINT) AS line FROM pre""",
)
def h5_down(spark, sf_dir):
    """Every word of a document, looked for from the second line on; those that stand in later paragraphs have an answer."""
    corpus = Corpus.of(text_docs(spark, sf_dir), SEGMENT_SOURCE)
    asked = _words_by(corpus.segments.filter("tag = 'p'").filter(F.col("hint_line") > 1), "doc_id")
    found = spelling.exact_lines(asked.withColumn("hint_line", F.lit(2)), corpus.docs)
    return found.select(F.col("doc_id").alias("document"), "word", "line")


@registry.add(
    "a17_segments",
    f"""{_T_SQL} SELECT {_T_SOURCE}, CAST(0 AS BIGINT) AS owner_id, CAST(0 AS BIGINT) AS seg_no, 'turn' AS tag, t AS text,
      CAST(1 AS BIGINT) AS hint_line FROM t WHERE t <> ''""",
)
def a17_segments(spark, sf_dir):
    return Corpus.of(turn_docs(spark, sf_dir), SEGMENT_SOURCE).segments.drop("head")


@registry.add(
    "a17_lines",
    f"""{_T_SQL} SELECT 'c' || c || '/t' || n || '.xml' AS document, generate_subscripts(string_split(xml, chr(10)), 1) AS line_no,
      unnest(string_split(xml, chr(10))) AS text FROM t""",
)
def a17_lines(spark, sf_dir):
    return Corpus.of(turn_docs(spark, sf_dir)).lines.withColumnRenamed("doc_id", "document")


@registry.add(
    "a18_source_lines",
    f"""{_T_SQL}, ln AS (
      SELECT c, n, t, generate_subscripts(string_split(xml, chr(10)), 1) AS l, unnest(string_split(xml, chr(10))) AS s FROM t)
    SELECT 'c' || c || '/t' || n || '.xml' AS document, CAST(1 AS BIGINT) AS line, l AS line_no, s AS text, l = 1 AS is_hit
    FROM ln WHERE contains(t, 'la') AND l <= 3""",
)
def a18(spark, sf_dir):
    docs = turn_docs(spark, sf_dir)
    hits = search.search_content(Corpus.of(docs, [*_KEYS, "text"]).nodes, ["turn"], "la")
    shown = with_source_lines(hits, docs, before=2, after=2)
    return shown.select(F.col("doc_id").alias("document"), "line", "line_no", "text", "is_hit")
