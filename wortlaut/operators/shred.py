"""Shredding: one pass over each document, one row per XML node.

The parse is the only step Spark cannot express with its own functions, so it is an Arrow map over the document
table: Spark reads, splits and schedules the documents, and the Python part is an event handler that fills columns.
Everything after it is plain DataFrame work on the resulting rows.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The attributes that make up a printed-source label.
LABEL_MARK, LABEL_FORMAT = "bwb", "BWB Bd. {band}, H. {heft}"

_BATCH_ROWS = 20_000
_BATCH_CHARS = 16_000_000
_START_TAG = re.compile(rb"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*")

_ATTRS = pa.list_(pa.struct([("name", pa.string()), ("local", pa.string()), ("value", pa.string())]))
_NODE_COLUMNS: dict[str, pa.DataType] = {
    "kind": pa.string(),  # element, comment, pi; error for a document that does not parse
    "node_id": pa.int32(),  # preorder number of elements, 0 = root
    "parent_id": pa.int32(),
    "end_id": pa.int32(),  # last descendant element
    "child_no": pa.int32(),  # place among the parent's element, comment and pi children
    "depth": pa.int32(),
    "ns": pa.string(),
    "tag": pa.string(),  # local name
    "parent_tag": pa.string(),
    "path": pa.string(),  # local names from the root, '/'-joined
    "first_in_doc": pa.bool_(),  # no earlier element of the document has this path
    "line": pa.int32(),  # line on which the start tag (comment, pi) ends
    "text": pa.string(),  # text before the first child node
    "tail": pa.string(),  # text between this node and the next one
    "string_len": pa.int64(),  # code points of all text inside the element
    "children": pa.string(),  # tags of the child elements, '|'-joined
    "attrs": _ATTRS,
    "column": pa.int32(),  # of an error
    "error": pa.string(),
    # Source between the start of the node's line and its text or tail: short, and only if the text stands there as it is.
    "text_head": pa.string(),
    "tail_head": pa.string(),
}
HEAD_COLUMNS = ("text_head", "tail_head")
_DOC_COLUMNS = ("doc_id", "doc_ord", "subdir", "filename")

_SPARK_TYPES = {
    pa.string(): T.StringType(),
    pa.int32(): T.IntegerType(),
    pa.int64(): T.LongType(),
    pa.bool_(): T.BooleanType(),
    _ATTRS: T.ArrayType(
        T.StructType([T.StructField(n, T.StringType()) for n in ("name", "local", "value")]), containsNull=False
    ),
}

#: What is built unless columns are named; heads cost a little, so they are built for who asks.
NODE_COLUMNS = (*_DOC_COLUMNS, "quelle", *(n for n in _NODE_COLUMNS if n not in HEAD_COLUMNS))


class _Rows:
    """Node rows of the documents of one Arrow batch."""

    def __init__(self, names: list[str], max_depth: int | None):
        self.names, self.max_depth = names, max_depth
        self.heads = not set(names).isdisjoint(HEAD_COLUMNS)
        self.rows: list[list] = []
        self.docs: list[int] = []
        self.labels: list[str] = []
        self.chars = 0
        self.xml_names: dict[str, tuple[str, str, str]] = {}

    def add_document(self, doc_no: int, content: bytes | None) -> None:
        rows, label, chars = parse_document(content, self.xml_names, self.max_depth, self.heads)
        self.rows += rows
        self.docs += [doc_no] * len(rows)
        self.labels += [label] * len(rows)
        self.chars += chars

    @staticmethod
    def attr_array(column: tuple) -> pa.Array:
        offsets, flat = [0], []
        for attrs in column:
            flat += attrs or ()
            offsets.append(len(flat))
        fields = [pa.array([a[i] for a in flat], pa.string()) for i in range(3)]
        struct = pa.StructArray.from_arrays(fields, fields=list(_ATTRS.value_type))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)

    def batches(self, source: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.rows), _BATCH_ROWS):
            part = slice(start, start + _BATCH_ROWS)
            columns = dict(zip(_NODE_COLUMNS, zip(*self.rows[part])))
            picked = pa.array(self.docs[part], pa.int32())
            arrays = []
            for name in self.names:
                if name in _DOC_COLUMNS:
                    arrays.append(source.column(name).take(picked))
                elif name == "quelle":
                    arrays.append(pa.array(self.labels[part], pa.string()))
                elif name == "attrs":
                    arrays.append(self.attr_array(columns[name]))
                else:
                    arrays.append(pa.array(columns[name], _NODE_COLUMNS[name]))
            yield pa.RecordBatch.from_arrays(arrays, names=self.names)


# Places in a node row that are filled after the row was begun.
_END_ID, _TEXT, _TAIL, _STRING_LEN, _CHILDREN = (
    list(_NODE_COLUMNS).index(n) for n in ("end_id", "text", "tail", "string_len", "children")
)
_ATTRS_AT, _DEPTH, _CHILD_NO, _LINE = (list(_NODE_COLUMNS).index(n) for n in ("attrs", "depth", "child_no", "line"))
#: From a text's place to the place of its head.
_TO_HEAD = {place: list(_NODE_COLUMNS).index(f"{n}_head") for n, place in (("text", _TEXT), ("tail", _TAIL))}
#: Line ends of str.splitlines() other than a line feed, in UTF-8; documents with such have no heads.
_ODD_LINE_END = re.compile(rb"[\r\x0b\x0c\x1c-\x1e]|\xc2\x85|\xe2\x80[\xa8\xa9]")
_HEAD_BYTES = 256


def parse_document(
    content: bytes | None, names: dict | None = None, max_depth: int | None = None, heads: bool = False
) -> tuple[list[list], str, int]:
    """Node rows of one document, its source label and its number of text characters.

    A document that does not parse gives exactly one row of kind ``error``, whatever was seen before the error.
    ``names`` remembers split names from one document to the next; ``max_depth`` is the number of levels from which a
    document counts as not parsing, if there is to be such a limit; ``heads`` asks for the head columns.
    """
    raw, encoding = content or b"", None
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raw, encoding = raw.decode("utf-16", errors="replace").encode("utf-8"), "utf-8"
    try:
        rows, chars = _node_rows(raw, encoding, {} if names is None else names, max_depth, heads)
    except expat.ExpatError as e:
        return [_error_row(e.lineno, e.offset + 1, expat.ErrorString(e.code))], "", 0
    except (ValueError, LookupError) as e:
        return [_error_row(0, 0, str(e))], "", 0
    return rows, _label(rows), chars


def _error_row(line: int, column: int, message: str) -> list:
    known = {"kind": "error", "line": line, "column": column, "error": message}
    return [known.get(name) for name in _NODE_COLUMNS]


def _split_name(name: str) -> tuple[str, str, str]:
    """(namespace, local name, {namespace}local) of a parser name"""
    ns, _, local = name.rpartition(" ")
    return ns, local, "{%s}%s" % (ns, local) if ns else local


def _node_rows(
    raw: bytes, encoding: str | None, names: dict, max_depth: int | None, heads: bool
) -> tuple[list[list], int]:
    """Rows of one document and its number of text characters, from parser events.

    The event handlers are closures, as looking attributes up would be a good part of their time.
    """
    rows: list[list] = []
    stack: list[tuple] = []  # per open element: row, node_id, tag, path, child tags, [children so far]
    paths: set[str] = set()
    buffer: list[str] = []
    slot, place = None, 0  # row and column the running text belongs to
    chars = elements = seen_to = 0
    line = 1
    parser = expat.ParserCreate(encoding, " ")
    find, count = raw.find, raw.count
    heads = heads and encoding is None and not _ODD_LINE_END.search(raw)
    text_from = text_line = 0  # where the running text may begin, and the line of the node in front of it

    def flush() -> None:
        nonlocal chars
        text = buffer[0] if len(buffer) == 1 else "".join(buffer)
        buffer.clear()
        chars += len(text)
        if slot is not None:
            slot[place] = text
            if heads and not text.isspace():
                slot[_TO_HEAD[place]] = text_head(text)

    def text_head(text: str) -> str | None:
        """The source in front of the running text, if that is on the node's line, not far from its start, and the text
        stands in the source as it is."""
        if raw[text_from : parser.CurrentByteIndex] != text.encode() or advance(text_from) != text_line:
            return None
        low = max(0, text_from - _HEAD_BYTES)
        line_start = raw.rfind(b"\n", low, text_from) + 1
        try:
            return raw[line_start:text_from].decode() if line_start or not low else None
        except UnicodeDecodeError:
            return None

    def advance(offset: int) -> int:
        """The line of a byte offset."""
        nonlocal line, seen_to
        if offset > seen_to:
            line += count(b"\n", seen_to, offset)
            seen_to = offset
        return line

    def start(name: str, flat_attrs: list[str]) -> None:
        nonlocal elements, slot, place, text_from, text_line
        if buffer:
            flush()
        ns, tag, _ = names.get(name) or names.setdefault(name, _split_name(name))
        begin = parser.CurrentByteIndex
        end = find(b">", begin) if raw[begin] == 60 else begin  # no '<' here: the tag stands in an entity
        attrs = None
        if flat_attrs:
            attrs = []
            for key, value in zip(flat_attrs[::2], flat_attrs[1::2]):
                _, local, clark = names.get(key) or names.setdefault(key, _split_name(key))
                attrs.append((clark, local, value))
            if count(b'"', begin, end) % 2 or count(b"'", begin, end) % 2:  # the '>' stands in a value
                match = _START_TAG.match(raw, begin)
                end = match.end() if match else begin
        depth = len(stack)
        if depth:
            if max_depth and depth >= max_depth:
                raise ValueError(f"elements nested deeper than {max_depth}")
            _, parent_id, parent_tag, path, child_tags, counter = stack[-1]
            path = f"{path}/{tag}"
            child_tags.append(tag)
            child_no = counter[0]
            counter[0] += 1
        else:
            parent_id = parent_tag = child_no = None
            path = tag
        first = path not in paths
        if first:
            paths.add(path)
        # string_len holds the characters seen so far and becomes a length at the end tag
        row = ["element", elements, parent_id, None, child_no, depth, ns, tag, parent_tag, path, first, advance(end),
               None, None, chars, None, attrs, None, None, None, None]
        rows.append(row)
        stack.append((row, elements, tag, path, [], [0]))
        elements += 1
        slot, place = row, _TEXT
        text_from, text_line = end + 1, line

    def end(_name: str) -> None:
        nonlocal slot, place, text_from, text_line
        if buffer:
            flush()
        row, _, _, _, child_tags, _ = stack.pop()
        row[_CHILDREN] = "|".join(child_tags)
        row[_END_ID] = elements - 1
        row[_STRING_LEN] = chars - row[_STRING_LEN]
        slot, place = (row, _TAIL) if stack else (None, 0)
        if heads:
            at = parser.CurrentByteIndex  # of the end tag, or behind a tag without content
            text_from, text_line = find(b">", at) + 1 if raw[at : at + 2] == b"</" else at, row[_LINE]

    def other(kind: str, closing: bytes) -> None:
        nonlocal slot, place, text_from, text_line
        if buffer:
            flush()
        if stack:
            _, parent_id, parent_tag, path, _, counter = stack[-1]
            ends = find(closing, parser.CurrentByteIndex)
            row = [kind, None, parent_id, None, counter[0], len(stack), None, None, parent_tag, path, False,
                   advance(ends), None, None, None, None, None, None, None, None, None]
            counter[0] += 1
            rows.append(row)
            slot, place = row, _TAIL
            text_from, text_line = ends + len(closing), line

    parser.buffer_text = True
    parser.buffer_size = 1 << 16
    parser.ordered_attributes = True
    parser.StartElementHandler = start
    parser.EndElementHandler = end
    parser.CharacterDataHandler = buffer.append
    parser.CommentHandler = lambda _data: other("comment", b"-->")
    parser.ProcessingInstructionHandler = lambda _target, _data: other("pi", b"?>")
    try:
        parser.Parse(raw, True)
    finally:
        # parser and handlers refer to each other
        parser.StartElementHandler = parser.EndElementHandler = parser.CharacterDataHandler = None
        parser.CommentHandler = parser.ProcessingInstructionHandler = None
    return rows, chars


def _label(rows: list[list]) -> str:
    """Label of the printed source, from the root or one of its first three children."""
    for row in rows:
        if row[_DEPTH] == 1 and row[_CHILD_NO] >= 3:
            break
        if row[_DEPTH] <= 1 and row[_ATTRS_AT]:
            attrs = {name: value for name, _, value in row[_ATTRS_AT]}
            if attrs.get("wb", "").lower() == LABEL_MARK:
                return LABEL_FORMAT.format(band=attrs.get("band", "?"), heft=attrs.get("heft", "?"))
    return ""


def shred(docs: DataFrame, columns: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """Node rows of all documents: ``docs(doc_id, doc_ord, subdir, filename, content)`` → one row per node.

    Spark cannot prune columns through a Python map, so ``columns`` names the ones to build.  Rows of a document
    stay together, in document order, in the partition that held the document; no shuffle takes place.  A document
    with ``max_depth`` levels and more is reported as an error when that is given.
    """
    names = list(columns or NODE_COLUMNS)
    if "kind" not in names:
        names.append("kind")
    types = {"quelle": T.StringType(), **{n: docs.schema[n].dataType for n in _DOC_COLUMNS}}
    types.update((n, _SPARK_TYPES[t]) for n, t in _NODE_COLUMNS.items())
    schema = T.StructType([T.StructField(n, types[n]) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # rows hold no cycles, and scanning them again and again costs a third of the parse
        try:
            for batch in batches:
                out = _Rows(names, max_depth)
                for doc_no, content in enumerate(batch.column("content")):
                    out.add_document(doc_no, content.as_py())
                    if len(out.rows) >= _BATCH_ROWS or out.chars >= _BATCH_CHARS:
                        yield from out.batches(batch)
                        out = _Rows(names, max_depth)
                yield from out.batches(batch)
        finally:
            gc.enable()

    wanted = [n for n in _DOC_COLUMNS if n in names]
    return docs.select(*wanted, "content").mapInArrow(run, schema)
