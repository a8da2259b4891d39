"""What the registered queries share: table access, plain result types, corpora made from the given tables.

Documents are built row by row with native expressions, so building them needs no shuffle, and a result computed from
the XML can be computed from the table as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wortlaut.operators.results import POSITION
from wortlaut.sources import documents
from wortlaut.sources.documents import docs_from_table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Queries by name, and the SQL that gives the same rows."""

    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = lambda spark, sf_dir: plain(query(spark, sf_dir))
            if oracle is not None:
                self.oracles[name] = oracle
            return query

        return register


def plain(df: DataFrame) -> DataFrame:
    """Result columns in types any engine compares: 64-bit integers, arrays as text; without position columns."""

    def column(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("long").alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(c, "|").alias(f.name)
        return c

    return df.select(*(column(f) for f in df.schema if f.name not in POSITION))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The given tables are single files, so their rows are dealt out to all cores before they are parsed."""
    return documents.spread(rows, key, rows.sparkSession.sparkContext.defaultParallelism)


def escaped(column: str) -> str:
    return f"replace(replace({column}, '&', '&amp;'), '<', '&lt;')"


# Entries: one small dictionary article per order, with rule violations at fixed key remainders.
_SENSE = """
  concat('<sense n="', i, '" src="c', c % 7, '"><def>',
    if(i % 2 = 1, concat('sense of ', st), concat('x ', c % 5)), '</def>',
    element_at(array('', '<sense n="9"><def>deep</def></sense>', '<cit><sense n="8"/></cit>',
      '<sense n="9"><sense n="9"/></sense>'), cast((k + i) % 4 as int) + 1),
    '</sense>\n')
"""
_ENTRY = f"""
  concat('<', r, ' xmlns="urn:example:entries" xml:id="e', k, '"', if(k % 6 = 0, '', ' xml:lang="de"'),
    ' status="', st, '">\n',
    '<form', if(k % 5 = 0, ' bogus="1"', ''), '><orth>', pr, '</orth></form>',
    if(k % 7 = 0, '<note/>', ''), if(k % 9 = 0, '<orth>x</orth>', ''), if(k % 13 = 0, 'stray', ''), '\n',
    array_join(transform(filter(sequence(1, 3), i -> i <= c % 4), i -> {_SENSE}), ''),
    '</', closing, '>')
"""


def entry_docs(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """Articles of all orders; ``broken`` gives every 17th a wrong end tag."""
    rows = spread(table(spark, sf_dir, "orders"), "o_orderkey").selectExpr(
        "o_orderkey AS k", "o_custkey AS c", "o_orderstatus AS st", "o_orderpriority AS pr",
        "if(o_orderkey % 97 = 0, 'item', 'entry') AS r",
    )
    closing = "if(k % 17 = 0, 'broken', r)" if broken else "r"
    rows = rows.withColumn("closing", F.expr(closing))
    path = F.expr("concat('entries/s', k % 20, '/o', k, '.xml')")
    return docs_from_table(rows, path, F.expr(_ENTRY), F.col("k"))


# The same articles as rows: o(rders), s(enses), el(ements), att(ributes).  pos grows in document order.
ENTRY_SQL = """
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderpriority AS pr,
    CASE WHEN o_orderkey % 97 = 0 THEN 'item' ELSE 'entry' END AS r FROM orders),
s AS (
  SELECT *, (k + i) % 4 AS v, CASE WHEN i % 2 = 1 THEN 'sense of ' || st ELSE 'x ' || (c % 5) END AS d
  FROM (SELECT *, unnest(range(1, c % 4 + 1)) AS i FROM o)),
el AS (
  SELECT k, 0 AS pos, r AS path, r AS tag, 1 AS line, NULL AS text FROM o
  UNION ALL SELECT k, 1, r || '/form', 'form', 2, NULL FROM o
  UNION ALL SELECT k, 2, r || '/form/orth', 'orth', 2, pr FROM o
  UNION ALL SELECT k, 3, r || '/note', 'note', 2, NULL FROM o WHERE k % 7 = 0
  UNION ALL SELECT k, 4, r || '/orth', 'orth', 2, 'x' FROM o WHERE k % 9 = 0
  UNION ALL SELECT k, 10 * i, r || '/sense', 'sense', i + 2, NULL FROM s
  UNION ALL SELECT k, 10 * i + 1, r || '/sense/def', 'def', i + 2, d FROM s
  UNION ALL SELECT k, 10 * i + 2, r || '/sense/sense', 'sense', i + 2, NULL FROM s WHERE v IN (1, 3)
  UNION ALL SELECT k, 10 * i + 2, r || '/sense/cit', 'cit', i + 2, NULL FROM s WHERE v = 2
  UNION ALL SELECT k, 10 * i + 3, r || '/sense/sense/def', 'def', i + 2, 'deep' FROM s WHERE v = 1
  UNION ALL SELECT k, 10 * i + 3, r || '/sense/cit/sense', 'sense', i + 2, NULL FROM s WHERE v = 2
  UNION ALL SELECT k, 10 * i + 3, r || '/sense/sense/sense', 'sense', i + 2, NULL FROM s WHERE v = 3),
att AS (
  SELECT k, 0 AS pos, r AS path, r AS tag, 1 AS line, 'id' AS attr, 'e' || k AS value FROM o
  UNION ALL SELECT k, 0, r, r, 1, 'lang', 'de' FROM o WHERE k % 6 <> 0
  UNION ALL SELECT k, 0, r, r, 1, 'status', st FROM o
  UNION ALL SELECT k, 1, r || '/form', 'form', 2, 'bogus', '1' FROM o WHERE k % 5 = 0
  UNION ALL SELECT k, 10 * i, r || '/sense', 'sense', i + 2, 'n', CAST(i AS VARCHAR) FROM s
  UNION ALL SELECT k, 10 * i, r || '/sense', 'sense', i + 2, 'src', 'c' || (c % 7) FROM s
  UNION ALL SELECT k, 10 * i + 2, r || '/sense/sense', 'sense', i + 2, 'n', '9' FROM s WHERE v IN (1, 3)
  UNION ALL SELECT k, 10 * i + 3, r || '/sense/cit/sense', 'sense', i + 2, 'n', '8' FROM s WHERE v = 2
  UNION ALL SELECT k, 10 * i + 3, r || '/sense/sense/sense', 'sense', i + 2, 'n', '9' FROM s WHERE v = 3)
"""
ENTRY_SOURCE_SQL = "'' AS quelle, 'entries/s' || (k % 20) AS subdir, 'o' || k || '.xml' AS filename"

ENTRY_GRAMMAR = """<grammar xmlns="http://relaxng.org/ns/structure/1.0" ns="urn:example:entries"
    datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes">
  <start><ref name="entry"/></start>
  <define name="entry">
    <element name="entry">
      <attribute name="xml:id"><data type="ID"/></attribute>
      <attribute name="xml:lang"><data type="language"/></attribute>
      <attribute name="status"><choice><value>O</value><value>F</value></choice></attribute>
      <ref name="form"/>
      <oneOrMore><ref name="sense"/></oneOrMore>
    </element>
  </define>
  <define name="form"><element name="form"><ref name="orth"/></element></define>
  <define name="orth"><element name="orth"><text/></element></define>
  <define name="sense">
    <element name="sense">
      <attribute name="n"><data type="nonNegativeInteger"><param name="maxInclusive">8</param></data></attribute>
      <optional>
        <attribute name="src">
          <list><oneOrMore><data type="token"><param name="pattern">c[0-5]</param></data></oneOrMore></list>
        </attribute>
      </optional>
      <optional><ref name="def"/></optional>
      <zeroOrMore><choice><ref name="sense"/><ref name="cit"/></choice></zeroOrMore>
    </element>
  </define>
  <define name="def"><element name="def"><text/></element></define>
  <define name="cit"><element name="cit"><oneOrMore><ref name="sense"/></oneOrMore></element></define>
</grammar>"""


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per row of ``documents``, a paragraph per line of its text."""
    paragraphs = f"array_join(transform(split(text, '\\n'), l -> concat('<p>', {escaped('l')}, '</p>')), '\\n')"
    xml = F.expr(f"concat('<text source=\"', source, '\" xml:lang=\"', lang, '\">\\n', {paragraphs}, '\\n</text>')")
    path = F.expr("concat(source, '/', lang, '/d', doc_id, '.xml')")
    return docs_from_table(spread(table(spark, sf_dir, "documents"), "doc_id"), path, xml, F.col("doc_id"))


def turn_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per conversation turn, its text kept as it is, line ends included."""
    xml = F.expr(f"concat('<turn who=\"', role, '\" n=\"', turn, '\">', {escaped('text')}, '</turn>')")
    path = F.expr("concat('c', conv_id, '/t', turn, '.xml')")
    rows = spread(table(spark, sf_dir, "conversations"), "turn")
    return docs_from_table(rows, path, xml, F.expr("conv_id * 1000000 + turn"))


def page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("concat('pages/p', page_id, '.xml')")
    return docs_from_table(spread(table(spark, sf_dir, "pages"), "page_id"), path, F.col("html"), F.col("page_id"))
