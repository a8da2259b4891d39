"""Merged path tree of a corpus: which paths occur, with which attributes, values and texts.

Everything that grows with the corpus is reduced where it lies: a path or attribute that holds a large share of all nodes
leaves a partition as a handful of rows.  What is shuffled and ranked is as large as the schema of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wortlaut.functions.ordering import document_position
from wortlaut.functions.paths import parent, prefixes, suffix_predicate
from wortlaut.functions.text import is_blank, strip

# How many samples are kept and shown (limits of the feature; ``samples`` takes others).
MAX_TEXTS = 5
MAX_ATTR_VALUES = 20
MAX_TEXT_LENGTH = 120
INLINE_ATTR_VALUES = 5

ABSENT = "..."


TAG, ATTR, TEXT = "tag", "attr", "text_content"


def samples(
    nodes: DataFrame, *kinds: str, max_values: int = MAX_ATTR_VALUES, max_texts: int = MAX_TEXTS, max_length: int = MAX_TEXT_LENGTH
) -> DataFrame:
    """What occurs at each path, in one pass over the nodes: ``(path, kind, name, values, first_seen)``.

    Kind ``tag`` says that the path occurs, ``attr`` holds the first ``max_values`` distinct values of an attribute local
    name, ``text_content`` the first ``max_texts`` distinct direct texts, stripped and cut to ``max_length``.  First means by
    document, then by place.
    """
    kinds = kinds or (TAG, ATTR, TEXT)

    def fact(kind: str, name: Column, value: Column, minor: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"), minor.alias("minor"))

    none = F.lit("")
    facts = []
    if TAG in kinds:  # only the first element of a path in its document can be the first of all
        facts.append(F.array(F.when(F.col("first_in_doc"), fact(TAG, none, none, F.lit(0)))))
    if ATTR in kinds:
        facts.append(F.transform("attrs", lambda a, i: fact(ATTR, a["local"], a["value"], i)))
    if TEXT in kinds:
        example = F.substring(strip(F.col("text")), 1, max_length)
        facts.append(F.array(F.when(~is_blank(F.col("text")), fact(TEXT, none, example, F.lit(0)))))
    every = F.concat(*(F.coalesce(f, F.array()) for f in facts))
    rows = nodes.select("path", "doc_ord", "node_id", F.explode_outer(every).alias("f")).filter(F.col("f").isNotNull())
    rows = rows.select(
        "path", "f.kind", "f.name", "f.value", "doc_ord", (F.col("node_id") * F.lit(65536).cast("long") + F.col("f.minor")).alias("place")
    )
    keys = ("path", "kind", "name")
    # Per partition only the first values of each path can be among the first of all, so only those are shuffled.
    most = max(max_values, max_texts)
    early = rows.mapInPandas(lambda frames: _first_values(frames, most), rows.schema)
    seen = early.groupBy(*keys, "value").agg(F.min(F.struct("doc_ord", "place")).alias("at"))
    rank = Window.partitionBy(*keys).orderBy("at", "value")
    kept = seen.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= F.when(F.col("kind") == TEXT, max_texts).otherwise(max_values))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return kept.groupBy(*keys).agg(F.transform(ordered, lambda v: v["value"]).alias("values"), F.min("at").alias("first_seen"))


_MERGE_ROWS = 100_000
_EMIT_ROWS = 1_000_000


def _first_values(frames: Iterator[pd.DataFrame], most: int = MAX_ATTR_VALUES) -> Iterator[pd.DataFrame]:
    """The first values of each (path, kind, name) in one partition, at most as many as a sample holds.

    Built-in aggregates would carry every distinct value to the shuffle.  What is kept here grows with the number of
    paths only, and is handed on early should there be very many.
    """
    pending: list[pd.DataFrame] = []
    waiting = kept = 0

    def merge() -> pd.DataFrame:
        rows = pd.concat(pending, ignore_index=True).sort_values(["doc_ord", "place"])
        rows = rows.drop_duplicates(["path", "kind", "name", "value"])
        return rows.groupby(["path", "kind", "name"], sort=False).head(most)

    for frame in frames:
        pending.append(frame)
        waiting += len(frame)
        if waiting >= max(_MERGE_ROWS, kept):
            pending = [merge()]
            waiting, kept = 0, len(pending[0])
            if kept >= _EMIT_ROWS:
                yield pending[0]
                pending, kept = [], 0
    if pending:
        yield merge()


def path_attrs(nodes: DataFrame) -> DataFrame:
    """Per path and attribute local name the first 20 distinct values."""
    return samples(nodes, ATTR).select("path", F.col("name").alias("attr"), F.col("values").alias("attr_values"))


def path_texts(nodes: DataFrame) -> DataFrame:
    """Per path the first 5 distinct direct texts, stripped and cut."""
    return samples(nodes, TEXT).select("path", F.col("values").alias("text_examples"))


def _depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def _by_rank(parent_path: Column, path: Column, first_seen: str):
    """Order of the children of one parent: as first seen; roots by name."""
    return Window.partitionBy(parent_path).orderBy(F.when(parent_path == "", path), first_seen)


def path_tree(nodes: DataFrame) -> DataFrame:
    """One row per path: tag, depth, has_text, and its rank among the children of its parent path.

    Children rank in first-seen order over the whole corpus, roots alphabetically.
    """
    first_seen = F.min(F.when(F.col("first_in_doc"), document_position(nodes)))
    paths = nodes.groupBy("path").agg(F.max(~is_blank(F.col("text"))).alias("has_text"), first_seen.alias("first_seen"))
    tree = paths.withColumn("parent_path", parent(F.col("path")))
    return tree.select(
        "path", "parent_path", F.element_at(F.split("path", "/"), -1).alias("tag"), _depth(F.col("path")).alias("depth"),
        "has_text", F.row_number().over(_by_rank(F.col("parent_path"), F.col("path"), "first_seen")).alias("child_rank"),
    )


def _with_sort_key(paths: DataFrame) -> DataFrame:
    """Add ``has_inner`` and ``sort_key``, strings whose order is the depth-first order of the tree.

    Each level of the key is a child rank; '2' puts child tags after attributes ('0') and text ('1') of the same tag.
    Every path is set beside each path above it, where ranks are found by windows over the children of one parent, so
    ``paths`` is read once.
    """
    own = F.struct(*paths.columns)
    steps = paths.select(
        F.col("path").alias("_path"), own.alias("_row"), F.posexplode(prefixes(F.col("path"))).alias("level", "step")
    )
    is_self = F.col("step") == F.col("_path")
    at_step = Window.partitionBy("step")
    steps = steps.withColumn("_seen", F.max(F.when(is_self, F.col("_row.first_seen"))).over(at_step))
    steps = steps.withColumn("_inner", F.count(F.lit(1)).over(at_step) > 1)
    above = parent(F.col("step"))
    siblings = Window.partitionBy(above).orderBy(F.when(above == "", F.col("step")), "_seen", "step")
    steps = steps.withColumn("_rank", F.lpad(F.dense_rank().over(siblings).cast("string"), 9, "0"))
    levels = F.array_sort(F.collect_list(F.struct("level", "_rank")))
    keyed = steps.groupBy("_path").agg(
        F.array_join(F.transform(levels, lambda k: k["_rank"]), ".2").alias("sort_key"),
        F.first(F.when(F.col("step") == F.col("_path"), F.col("_row")), ignorenulls=True).alias("_row"),
        F.max(F.when(F.col("step") == F.col("_path"), F.col("_inner"))).alias("has_inner"),
    )
    return keyed.select("_row.*", "sort_key", "has_inner")


def _inline(values: Column) -> tuple[Column, Column]:
    return F.slice(values, 1, INLINE_ATTR_VALUES), F.greatest(F.lit(0), F.size(values) - INLINE_ATTR_VALUES)


def tree_rows(nodes: DataFrame) -> DataFrame:
    """Display rows of the merged tree: tags, their attributes, their text.  Order by ``sort_key``.

    The nodes are read once; they are reduced to one row per path, and the rows are built from it.
    """
    attr = F.struct("name", "values")
    paths = (
        samples(nodes)
        .groupBy("path")
        .agg(
            F.min(F.when(F.col("kind") == TAG, F.col("first_seen"))).alias("first_seen"),
            F.max(F.col("kind") == TEXT).alias("has_text"),
            F.array_sort(F.collect_list(F.when(F.col("kind") == ATTR, attr))).alias("attrs"),
        )
    )
    path, depth, key = F.col("path"), _depth(F.col("path")), F.col("sort_key")
    no_values = F.array().cast("array<string>")

    def row(suffix: Column, deeper: int, kind: str, label: Column, values: Column, content: bool, children: Column):
        place = F.lit("") if kind == TAG else F.lit(".1") if kind == TEXT else F.concat(F.lit(".0"), F.substring(label, 2, 1 << 20))
        return F.struct(
            F.concat(path, suffix).alias("id"), (depth + deeper).alias("depth"), F.lit(kind).alias("kind"),
            label.alias("label"), children.alias("has_children"), F.lit(content).alias("has_content"),
            values.alias("attr_values"), F.concat(key, place).alias("sort_key"),
        )

    never = F.lit(False)
    tag_name = F.element_at(F.split(path, "/"), -1)
    has_children = F.col("has_text") | F.col("has_inner") | (F.size("attrs") > 0)
    tag_row = row(F.lit(""), 0, TAG, tag_name, no_values, False, has_children)
    text_row = row(F.lit("/#text"), 1, TEXT, F.lit("#text"), no_values, True, never)
    attr_rows = F.transform(
        "attrs",
        lambda a: row(F.concat(F.lit("/@"), a["name"]), 1, ATTR, F.concat(F.lit("@"), a["name"]), a["values"], True, never),
    )
    all_rows = F.concat(F.array(tag_row), attr_rows, F.when(F.col("has_text"), F.array(text_row)).otherwise(F.array()))
    shown = _with_sort_key(paths).select("path", F.explode(all_rows).alias("r")).select("path", "r.*")
    inline, extra = _inline(F.col("attr_values"))
    return shown.select(
        "id", "path", "depth", "kind", "label", "has_children", "has_content",
        F.lit(True).alias("is_visible"), F.lit(False).alias("is_collapsed"),
        F.lit(False).alias("example_loaded"), F.lit("").alias("example_value"),
        "attr_values", inline.alias("inline_attr_values"), extra.alias("extra_attr_count"),
        F.lit(False).alias("is_search_match"), "sort_key",
    )


def collapsible(rows: DataFrame, max_open_depth: int = 0) -> DataFrame:
    """Ids of the tag rows a collapse from this depth on closes."""
    return rows.filter((F.col("kind") == TAG) & F.col("has_children") & (F.col("depth") >= max_open_depth)).select("id")


def set_visibility(rows: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Flag collapsed tag rows and the rows that stay visible: those without a collapsed ancestor tag.

    ``collapsed`` is a table of row ids: empty to expand all, ``collapsible(rows)`` to collapse all.
    """
    closed = collapsed.select(F.col("id").alias("step"), F.lit(True).alias("closed")).distinct()
    # A tag row's path ends in itself; attribute and text rows have the path of the tag above them.
    steps = rows.withColumn("step", F.explode(prefixes(F.col("path")))).join(closed, "step", "left")
    own = (F.col("kind") == TAG) & (F.col("step") == F.col("path"))
    is_closed = F.coalesce("closed", F.lit(False))
    kept = [c for c in rows.columns if c not in ("is_collapsed", "is_visible")]
    flagged = steps.groupBy(*kept).agg(
        F.max(own & is_closed).alias("is_collapsed"), (~F.max(~own & is_closed)).alias("is_visible")
    )
    return flagged.select(*rows.columns)


def default_collapse(rows: DataFrame, max_open_depth: int = 1) -> DataFrame:
    """Collapse every tag row with content from this depth on.

    A tag above another row has content, so a row is hidden exactly when its parent is at this depth or deeper.
    """
    closed = (F.col("kind") == TAG) & F.col("has_children") & (F.col("depth") >= max_open_depth)
    return rows.withColumn("is_collapsed", closed).withColumn("is_visible", F.col("depth") <= max_open_depth)


def visible_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("is_visible")


def search_tree(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose label, loaded example or inline values contain the query, their ancestors, and the attribute and
    text rows of every tag kept."""
    needle = query.lower().strip()
    if not needle:
        return rows.filter("is_visible")
    wanted = F.lit(needle)
    in_example = (
        F.col("example_loaded")
        & ~F.col("example_value").isin("", "—", ABSENT)
        & F.contains(F.lower("example_value"), wanted)
    )
    in_values = F.exists("inline_attr_values", lambda v: F.contains(F.lower(v), wanted))
    flagged = rows.withColumn("is_search_match", F.contains(F.lower("label"), wanted) | in_example | in_values)
    # A path is kept when a hit lies at it or below it.  Attribute and text rows have the path of their tag.
    kept = flagged.filter("is_search_match").select(F.explode(prefixes(F.col("path"))).alias("path")).distinct()
    return flagged.join(kept, "path", "left_semi").select(*rows.columns).withColumn("is_visible", F.lit(True))


def project_doc(rows: DataFrame, doc_nodes: DataFrame) -> DataFrame:
    """The tree with inline values and text examples of one document only (its nodes); the full value list stays."""
    suffix = F.when(F.col("kind") == ATTR, F.concat(F.lit("/@"), "name")).otherwise(F.lit("/#text"))
    own = samples(doc_nodes, ATTR, TEXT).select(F.concat("path", suffix).alias("id"), F.col("values").alias("own"))
    values = F.coalesce("own", F.array().cast("array<string>"))
    inline, extra = _inline(values)
    first_text = F.coalesce(F.get(values, F.lit(0)), F.lit(ABSENT))
    is_attr, is_text = F.col("kind") == ATTR, F.col("kind") == TEXT
    changed = {
        "inline_attr_values": F.when(is_attr, inline).otherwise(F.col("inline_attr_values")),
        "extra_attr_count": F.when(is_attr, extra).otherwise(F.col("extra_attr_count")),
        "has_content": F.when(is_attr | is_text, F.size(values) > 0).otherwise(F.col("has_content")),
        "example_loaded": is_text | F.col("example_loaded"),
        "example_value": F.when(is_text, first_text).otherwise(F.col("example_value")),
    }
    joined = rows.join(own, "id", "left")
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns))


def all_docs(rows: DataFrame) -> DataFrame:
    """Back from one document to the values of the whole corpus."""
    inline, extra = _inline(F.col("attr_values"))
    is_attr, is_text = F.col("kind") == ATTR, F.col("kind") == TEXT
    return rows.withColumns(
        {
            "inline_attr_values": F.when(is_attr, inline).otherwise(F.col("inline_attr_values")),
            "extra_attr_count": F.when(is_attr, extra).otherwise(F.col("extra_attr_count")),
            "has_content": F.when(is_attr, F.size("attr_values") > 0).when(is_text, True).otherwise(F.col("has_content")),
            "example_loaded": F.when(is_text, False).otherwise(F.col("example_loaded")),
            "example_value": F.when(is_text, F.lit("")).otherwise(F.col("example_value")),
        }
    )


def find_example(nodes: DataFrame, path: str, file_suffix: str = "", exclude: str = "") -> DataFrame:
    """At most one row: the first text at a path suffix that differs from ``exclude``."""
    example = F.substring(strip(F.col("text")), 1, MAX_TEXT_LENGTH)
    matched = nodes.filter(suffix_predicate(path) & ~is_blank(F.col("text")) & F.col("doc_id").endswith(file_suffix))
    others = matched.withColumn("example", example).filter(F.col("example") != exclude)
    return others.orderBy("doc_ord", "node_id").limit(1).select("doc_id", "example")


def attr_row_values(rows: DataFrame, row_id: str) -> DataFrame:
    """All sampled values of one attribute row, in order."""
    return rows.filter(F.col("id") == row_id).select(F.posexplode("attr_values").alias("no", "value"))
