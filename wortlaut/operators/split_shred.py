"""Shredding files of any size in splits that begin and end at an entry.

A file is read in records that end at the end tag of an entry element, so one file is work for many tasks.  A task puts
the records of a split together to chunks of about a megabyte, and parses each between the start of the file (its
declarations and the root's start tag) and the root's end tag, so namespaces and entities are known in every chunk.
Numbers in a chunk are relative; one line per chunk, summed up in file order, makes them those of the whole file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wortlaut.functions.sizes import staged
from wortlaut.operators import shred as whole
from wortlaut.operators.corpus import Corpus
from wortlaut.sources.documents import docs_from_table, looks_like_xml, scan_corpus, scan_records, with_location

#: Bytes of a chunk, give or take a record.
CHUNK_BYTES = 1 << 20

_KEYS = ["doc_id", "split", "chunk"]
_NODE_FIELDS = [(n, kind) for n, kind in whole._NODE_COLUMNS.items() if n not in ("column", *whole.HEAD_COLUMNS)]
_CHUNK_FIELDS = [
    ("doc_id", pa.string()),
    ("split", pa.int64()),
    ("chunk", pa.int64()),  # number inside the split
    ("is_root", pa.bool_()),  # the line of the chunk: its root, or what kept it from being parsed
    ("last_child", pa.bool_()),  # the last child node of the root in this chunk
    ("kids", pa.int32()),  # of the root in this chunk
    ("lines", pa.int64()),  # line feeds of the chunk
    ("closes", pa.bool_()),  # holds the root's end tag
]
_LINE, _PARENT, _DEPTH = (list(whole._NODE_COLUMNS).index(n) for n in ("line", "parent_id", "depth"))
_ROOT_END = rb"</%s\s*>(?:\s|<!--(?:(?!--).)*-->|<\?(?:(?!\?>).)*\?>)*\Z"


def _opening(record: bytes) -> tuple[bytes, bytes] | None:
    """What a file has up to the end of its root's start tag, and the root's name; None if there is none."""
    found: list[tuple[int, str]] = []
    parser = expat.ParserCreate()
    parser.StartElementHandler = lambda name, _attrs: found or found.append((parser.CurrentByteIndex, name))
    try:
        parser.Parse(record, False)
    except expat.ExpatError:
        pass  # later in the record, or before any element
    finally:
        parser.StartElementHandler = None
    tag = whole._START_TAG.match(record, found[0][0]) if found else None
    return (record[: tag.end() + 1], found[0][1].encode()) if tag else None


def _openings(records: DataFrame, strict_sniff: bool) -> DataFrame:
    """``doc_id``, ``split``, ``opening``, ``root`` of each split of the files that look like XML.

    The first record of a file is the first one its first split's task meets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = []
            for place, doc in enumerate(batch.column("doc_id").to_pylist()):
                if doc != last:
                    record = batch.column("value")[place].as_py()
                    rows.append((doc, record[:200], *(_opening(record) or (None, None))))
                    last = doc
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "head", "opening", "root"]
            )

    first = records.filter("split = 0").select("doc_id", "value")
    heads = first.mapInArrow(run, "doc_id string, head binary, opening binary, root binary")
    heads = heads.filter(looks_like_xml(F.col("head"), strict_sniff)).drop("head")
    return records.select("doc_id", "split").distinct().join(heads, "doc_id")


class _Chunk:
    """Records of one split on their way to node rows."""

    def __init__(self, key: tuple, opening: bytes | None, root: bytes | None, starts_file: bool, end: bytes):
        self.key, self.opening, self.root = key, opening, root
        self.starts_file, self.end = starts_file, end
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, record: bytes) -> None:
        self.parts.append(record)
        self.size += len(record) + len(self.end)

    def batches(self, names: dict, max_depth: int | None, last_of_split: bool) -> Iterator[pa.RecordBatch]:
        """The rows of the chunk; the records but a file's last one get their end tag back."""
        closes = bool(
            last_of_split and self.root and re.search(_ROOT_END % re.escape(self.root), self.parts[-1], re.DOTALL)
        )
        own = self.end.join(self.parts) + (b"" if closes else self.end)
        before = b"" if self.starts_file or self.opening is None else self.opening
        after = b"" if closes or self.root is None else b"</%s>" % self.root
        rows, _, _ = whole.parse_document(before + own + after, names, max_depth)
        kids = [i for i, row in enumerate(rows) if row[_PARENT] == 0 and row[_DEPTH] == 1]
        skipped = before.count(b"\n")
        for row in rows:
            row[_LINE] -= skipped
        shared = (*self.key, False, False, None, None, None)
        lines = [shared] * len(rows)
        lines[0] = (*self.key, True, False, len(kids), own.count(b"\n"), closes)
        if kids:
            lines[kids[-1]] = (*self.key, False, True, None, None, None)
        for start in range(0, len(rows), whole._BATCH_ROWS):
            part = slice(start, start + whole._BATCH_ROWS)
            columns = dict(zip(whole._NODE_COLUMNS, zip(*rows[part], strict=True), strict=True))
            arrays = [pa.array(c, k) for c, (_, k) in zip(zip(*lines[part], strict=True), _CHUNK_FIELDS, strict=True)]
            for name, kind in _NODE_FIELDS:
                arrays.append(whole._Rows.attr_array(columns[name]) if name == "attrs" else pa.array(columns[name], kind))
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in _CHUNK_FIELDS + _NODE_FIELDS])


def _chunk_rows(records: DataFrame, openings: DataFrame, end: str, chunk_bytes: int, max_depth: int | None) -> DataFrame:
    """Node rows of every chunk, with numbers as in the chunk."""
    close = end.encode()
    plain = {pa.int64(): T.LongType(), **whole._SPARK_TYPES}
    schema = T.StructType([T.StructField(n, plain[k]) for n, k in _CHUNK_FIELDS + _NODE_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, names = None, {}
        for batch in batches:
            for doc, split, value, opening, root in zip(*(batch.column(i) for i in range(5)), strict=True):
                place = doc.as_py(), split.as_py()
                if chunk is not None and chunk.key[:2] != place:
                    yield from chunk.batches(names, max_depth, last_of_split=True)
                    chunk = None
                elif chunk is not None and chunk.size >= chunk_bytes:
                    yield from chunk.batches(names, max_depth, last_of_split=False)
                    chunk = _Chunk((*place, chunk.key[2] + 1), chunk.opening, chunk.root, False, close)
                if chunk is None:
                    chunk = _Chunk((*place, 0), opening.as_py(), root.as_py(), place[1] == 0, close)
                chunk.add(value.as_py())
        if chunk is not None:
            yield from chunk.batches(names, max_depth, last_of_split=True)

    rows = records.join(openings, ["doc_id", "split"]).sortWithinPartitions("doc_id", "split", "place")
    return rows.select("doc_id", "split", "value", "opening", "root").mapInArrow(run, schema)


def _placed(rows: DataFrame) -> DataFrame:
    """One line per chunk: what comes before it in its file, the text after its last child, and whether the file's chunks
    all parse and the last one closes the root (``good``)."""
    in_file = Window.partitionBy("doc_id").orderBy("split", "chunk")
    earlier, file = in_file.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("doc_id")
    chunks = rows.filter("is_root").select(
        *_KEYS, "lines", "kids", "closes", "children", (F.col("kind") == "error").alias("broken"),
        F.col("end_id").cast("long").alias("elements"), F.col("string_len").alias("chars"), F.col("text").alias("lead"),
    )
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    last = F.lead("split").over(in_file).isNull()
    return (
        chunks.withColumn("number", F.row_number().over(in_file))
        .withColumns({f"{c}_before": before(c).cast("int") for c in ("elements", "kids", "lines")})
        .withColumn("follow", F.lead("lead").over(in_file))
        .withColumn("odd", F.col("broken") | (F.col("closes") != last))
        .withColumn("good", ~F.max("odd").over(file))
    )


def _labels(nodes: DataFrame) -> DataFrame:
    """The label of the printed source per file, as ``shred`` finds it on the root or its first three child nodes."""

    def attr(name: str) -> Column:
        return F.get(F.filter("attrs", lambda a: a["name"] == name), F.lit(0))["value"]

    text = whole.LABEL_FORMAT.replace("{band}", "%s").replace("{heft}", "%s")
    marked = nodes.filter((F.col("depth") <= 1) & (F.coalesce("child_no", F.lit(0)) < 3) & (F.lower(attr("wb")) == whole.LABEL_MARK))
    label = F.format_string(text, F.coalesce(attr("band"), F.lit("?")), F.coalesce(attr("heft"), F.lit("?")))
    return marked.groupBy("doc_id").agg(F.min_by(label, "node_id").alias("quelle"))


def shred_entries(
    spark: SparkSession, path: str, row_tag: str, glob: str = "*.xml", columns: list[str] | None = None,
    max_depth: int | None = None, chunk_bytes: int = CHUNK_BYTES, strict_sniff: bool = False,
) -> DataFrame:
    """The node rows ``shred(scan_corpus(…))`` gives, for files of any size whose root holds many ``row_tag`` elements.

    ``row_tag`` is the name as it stands in the file, with its prefix.  Each file is cut behind every end tag of such an
    element.  That is right where each one closes a child of the root, as in dictionaries; a file in which it does not
    (elements of that name inside one another or below other elements, an end tag inside a comment) shows by a chunk that does not parse, and
    is then put together and shredded whole, like a file that is not well formed, which gives its error as before.

    Rows are staged in the shared folder once; nothing but one line per chunk is sorted within a file.  Only the root's
    ``children`` grows with the file, as a list of its child tags.  A file may have 2^31 - 1 elements and lines.
    """
    names = list(dict.fromkeys([*(columns or whole.NODE_COLUMNS), "kind"]))
    end = f"</{row_tag}>"
    records = scan_records(spark, path, end, glob)
    openings = staged(_openings(records, strict_sniff))  # few lines, which Spark then broadcasts
    rows = staged(_chunk_rows(records, openings, end, chunk_bytes, max_depth))

    placed = _placed(rows)
    good = placed.filter("good")
    moved = rows.filter(~F.col("is_root")).join(good.drop("children", "lines", "kids", "closes"), _KEYS)
    top = F.col("parent_id") == 0
    nodes = moved.withColumns(
        {
            "node_id": F.col("node_id") + F.col("elements_before"),
            "parent_id": F.when(top, 0).otherwise(F.col("parent_id") + F.col("elements_before")),
            "end_id": F.col("end_id") + F.col("elements_before"),
            "child_no": F.when(top, F.col("child_no") + F.col("kids_before")).otherwise(F.col("child_no")),
            "line": F.col("line") + F.col("lines_before"),
            "tail": F.when(F.col("last_child"), F.coalesce("follow", "tail")).otherwise(F.col("tail")),
        }
    )
    firsts = nodes.filter("first_in_doc").groupBy("doc_id", "path").agg(F.min("number").alias("number"))
    nodes = nodes.join(firsts.withColumn("is_first", F.lit(True)), ["doc_id", "path", "number"], "left")
    nodes = nodes.withColumn("first_in_doc", F.col("first_in_doc") & F.coalesce("is_first", F.lit(False)))

    tags = F.array_sort(F.collect_list(F.when(F.col("children") != "", F.struct("number", "children"))))
    files = good.groupBy("doc_id").agg(
        F.sum("elements").cast("int").alias("end_id"), F.sum("chars").alias("string_len"),
        F.array_join(F.transform(tags, lambda c: c["children"]), "|").alias("children"),
    )
    roots = rows.filter("is_root AND split = 0 AND chunk = 0").drop("end_id", "string_len", "children").join(files, "doc_id")
    fields = ["doc_id", *(n for n, _ in _NODE_FIELDS)]
    every = roots.select(fields).unionByName(nodes.select(fields))
    if "quelle" in names:
        near = rows.filter("depth <= 1").join(good.select(*_KEYS, "kids_before", "elements_before"), _KEYS)
        near = near.filter("NOT is_root OR split = 0 AND chunk = 0").withColumns(
            {"child_no": F.col("child_no") + F.col("kids_before"), "node_id": F.col("node_id") + F.col("elements_before")}
        )
        every = every.join(_labels(near), "doc_id", "left").withColumn("quelle", F.coalesce("quelle", F.lit("")))
    unknown = {"column": F.lit(None).cast("int"), **{n: F.lit(None).cast("string") for n in whole.HEAD_COLUMNS}}
    located = with_location(every.withColumns(unknown), F.col("doc_id"))
    located = located.withColumn("doc_ord", F.col("doc_id")).select(names)

    odd = records.join(placed.filter(~F.col("good")).select("doc_id").distinct(), "doc_id", "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("split", "place", F.col("value").cast("string").alias("v"))))
    joined = F.array_join(F.transform(parts, lambda r: r["v"]), end)
    ends_so = F.sum(F.octet_length("value") + len(end.encode())) <= F.max("size")  # with an end tag, which no record holds
    content = F.concat(joined, F.when(ends_so, end).otherwise(""))
    again = docs_from_table(odd.groupBy("doc_id").agg(content.alias("content")), F.col("doc_id"), F.col("content"))
    return located.unionByName(whole.shred(again, names, max_depth))


def entry_corpus(spark: SparkSession, path: str, row_tag: str, glob: str = "*.xml", columns: list[str] | None = None) -> Corpus:
    """The corpus of a directory of large files.  Its document table is read only by what asks for source lines."""
    return Corpus(scan_corpus(spark, path, glob), shred_entries(spark, path, row_tag, glob, columns))
