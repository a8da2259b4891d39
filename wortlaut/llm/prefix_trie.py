"""Conversations as a trie of turns, with subtree totals by a depth-band rollup."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wortlaut.llm.shared import WORD, checkpointed, give_back, salt_mask, salt_of, text_of

#: Depths of one band.
BAND = 16
#: Equal turns placed by one array; conversation ids joined into one string, as a power of two.
_RUN, _CHUNK_BITS = 65_536, 10


def _before(order: list[Column]) -> Column:
    """Running sum of ``m`` over the rows before, inside one conversation and partition."""
    earlier = Window.partitionBy("conv", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("m").over(earlier), F.lit(0))


def numbered_turns(
    conversations: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    group: int = 20,
    openings: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (``conv``, ``depth`` from 1, ``digest``, ``words``, ``length``) and conversations (``conv``, ``length``).

    Conversation c takes its first h turns from conversation c - c % ``group``, h = crc32(c) % ``openings`` (all if
    that has fewer, none if there is no such conversation), and its own turns after the first h.  ``openings=1`` leaves
    conversations as they are.  Turns are ordered by ``turn``, null first, then by a digest of role and text; equal rows
    are turns of their own.  A null role or text is empty; rows without ``key`` take no part.

    Texts become digests and word counts at once and are never moved.  Rows are sorted over all tasks; a turn's number
    is what comes before it in its task and in earlier ones, so a conversation may spread over any number of tasks.
    """
    speaker, said = F.coalesce(F.col(role), F.lit("")), text_of(text)
    rows = conversations.select(
        F.col(key).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.sha2(F.concat(F.length(speaker).cast("string"), F.lit(":"), speaker, said), 256).alias("digest"),
        F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"),
    ).filter(F.col("conv").isNotNull())
    equal = rows.groupBy("conv", "turn", "digest").agg(F.count(F.lit(1)).alias("m"), F.max("words").alias("words"))
    order = [F.asc_nulls_first("turn"), F.asc("digest")]
    dealt = equal.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id())
    dealt = checkpointed(dealt)

    # One line per conversation and task that holds some of it.
    pieces = dealt.groupBy("conv", "part").agg(F.sum("m").alias("m"))
    by_part = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum("m").over(by_part), F.lit(0)))
    pieces = pieces.withColumn("own", F.sum("m").over(Window.partitionBy("conv")))
    skipped = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(openings)).cast("long")
    pieces = pieces.withColumn("skipped", skipped).withColumn("base", F.col("conv") - F.col("conv") % group)
    lengths = pieces.groupBy("conv").agg(F.max("own").alias("given"))
    pieces = pieces.join(lengths.withColumnRenamed("conv", "base"), "base", "left")
    taken = F.least("skipped", F.coalesce("given", F.lit(0)))
    pieces = pieces.withColumn("taken", taken).withColumn(
        "length", F.col("taken") + F.greatest(F.col("own") - F.col("skipped"), F.lit(0))
    )
    pieces = checkpointed(pieces.select("conv", "part", "start", "base", "skipped", "taken", "length"))

    placed = dealt.withColumn("before", _before(order)).join(pieces, ["conv", "part"])
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / _RUN)))
    inside = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_RUN).cast("long"), F.col("m") - F.col("run") * _RUN)))
    placed = placed.withColumn("run", run).withColumn("n", inside)
    placed = placed.withColumn("place", F.col("start") + F.col("before") + F.col("run") * _RUN + F.col("n"))
    placed = checkpointed(placed.select("conv", "place", "digest", "words", "skipped", "taken", "length"))

    own = placed.filter(F.col("place") > F.col("skipped")).select(
        "conv", (F.col("place") - F.col("skipped") + F.col("taken")).alias("depth"), "digest", "words", "length"
    )
    convs = pieces.select("conv", "base", "taken", "length").distinct()
    heads = placed.filter(F.col("place") < openings).select(F.col("conv").alias("base"), F.col("place").alias("depth"), "digest", "words")
    first = convs.filter("taken > 0").join(heads, "base").filter(F.col("depth") <= F.col("taken"))
    turns = own.unionByName(first.select("conv", "depth", "digest", "words", "length"))
    return checkpointed(turns), convs.select("conv", "length")


def _band_of(depth: str, band: int) -> Column:
    return F.floor(F.col(depth) / band).cast("long")


def _prefixes(turns: DataFrame, deepest: int, band: int) -> DataFrame:
    """``turns`` (``conv``, ``depth`` from 1, ``digest``, …) with ``prefix``: a digest of all turns up to this one.

    The turns of a band are joined up to this one; the full bands before it are themselves a sequence of digests, one
    per band, whose prefixes come the same way.  So each level has a ``band``-th of the rows, and no window holds more
    than ``band`` rows.
    """
    row = Window.partitionBy("conv", "_band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    banded = turns.withColumn("_band", F.floor((F.col("depth") - 1) / band).cast("long"))
    banded = banded.withColumn("_here", F.sha2(F.concat_ws("", F.collect_list("digest").over(row)), 256))
    if deepest <= band:
        return banded.withColumn("prefix", F.col("_here")).drop("_band", "_here")
    full = banded.filter(F.col("depth") % band == 0)
    full = full.select("conv", (F.col("_band") + 1).alias("depth"), F.col("_here").alias("digest"))
    above = _prefixes(full, deepest // band, band)
    above = above.select(F.col("conv"), F.col("depth").alias("_band"), F.col("prefix").alias("_above"))
    joined = banded.join(above, ["conv", "_band"], "left")
    return joined.withColumn("prefix", F.sha2(F.concat_ws(":", "_above", "_here"), 256)).drop("_band", "_above", "_here")


def _with_path(rows: DataFrame, band: int) -> DataFrame:
    """The nodes of ``rows`` (``conv``, ``depth``, ``rep``, …) with ``path``: the nodes above them in one band.

    A node is named by its depth and its smallest conversation ``rep``, and lies on that conversation's own path.  The
    nodes inside a band come with what is above them in it (``top`` is false); the first node of a band comes once more
    with the whole path through the band above (``top``), where its totals go.  No window holds more than ``band`` + 1 rows.
    """
    own = _band_of("depth", band)
    above = F.when((F.col("depth") % band == 0) & (F.col("depth") > 0), F.array(own, own - 1)).otherwise(F.array(own))
    row = Window.partitionBy("conv", "_band").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("_band", F.explode(above)).withColumn("path", F.collect_list("rep").over(row))
    return both.filter(F.col("rep") == F.col("conv")).withColumn("top", F.col("_band") != own)


def _rollup(rows: DataFrame, deepest: int, band: int, values: tuple[str, ...]) -> DataFrame:
    """Totals over the subtree of every node: ``depth``, ``rep`` and the sums of ``values``.

    ``rows`` has a row per conversation and depth; the values are read where the conversation names the node.  Within a
    band a node adds to itself and at most ``band`` - 1 nodes above.  The first nodes of the bands are a tree of their own,
    a ``band``-th as deep, whose totals come the same way; each then adds its complete total to the ``band`` nodes
    above it.  So the number of rounds is the logarithm of the depth to the base ``band``.
    """
    paths = checkpointed(_with_path(rows, band).select("_band", "path", "top", "depth", "rep", *values))
    inner = paths.filter(~F.col("top"))
    named = F.concat("path", F.array("rep"))
    first_depth = F.col("_band") * band
    sums = [F.sum(v).alias(v) for v in values]

    def added(nodes: DataFrame, reached: Column) -> DataFrame:
        spread = nodes.select(first_depth.alias("_from"), F.posexplode(reached).alias("_i", "rep"), *values)
        return spread.select((F.col("_from") + F.col("_i")).alias("depth"), "rep", *values)

    parts = added(inner.select("_band", named.alias("reached"), *values), F.col("reached"))
    if deepest >= band:
        firsts = inner.select(F.col("_band").alias("depth"), F.element_at(named, 1).alias("rep"), *values)
        whole = firsts.groupBy("depth", "rep").agg(*sums)
        tree = rows.filter(F.col("depth") % band == 0).select("conv", _band_of("depth", band).alias("depth"), "rep")
        named_here = F.col("rep") == F.col("conv")
        tree = tree.filter(named_here).join(whole, ["depth", "rep"]).unionByName(
            tree.filter(~named_here).select("*", *(F.lit(0).cast("long").alias(v) for v in values))
        )
        done = _rollup(tree, deepest // band, band, values)
        below = done.withColumn("depth", F.col("depth") * band)
        tops = paths.filter("top").select("_band", "path", "depth", "rep").join(below, ["depth", "rep"])
        parts = parts.unionByName(added(tops.select("_band", "path", *values), F.col("path")))
    return parts.groupBy("depth", "rep").agg(*sums)


def _joined_ids(ends: DataFrame) -> DataFrame:
    """``depth``, ``rep``, ``ends_sha256`` of the conversations that end at each node, which has one such at least.

    Ids are first joined by ranges of 1,024, so a node where many end has few rows; these are sorted by node and range
    and stream through a hash, which is one sequence by nature.  A task holds one range at a time.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy("depth", "rep", F.shiftright("conv", _CHUNK_BITS).alias("chunk")).agg(text.alias("ids"))
    dealt = chunks.repartition("depth", "rep").sortWithinPartitions("depth", "rep", "chunk")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            depth, rep, digest = zip(*rows, strict=True)
            columns = [pa.array(depth, pa.int64()), pa.array(rep, pa.int64()), pa.array(digest, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["depth", "rep", "ends_sha256"])

        for batch in batches:
            places = zip(batch.column("depth").to_pylist(), batch.column("rep").to_pylist(), strict=True)
            for at, ids in zip(places, batch.column("ids"), strict=True):
                if at != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = at, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            if done:
                yield batch_of(done)
                done = []
        if node is not None:
            yield batch_of([(*node, state.hexdigest())])

    return dealt.mapInArrow(hashed, "depth long, rep long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    group: int = 20,
    openings: int = 4,
    band: int = BAND,
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (``numbered_turns`` says how they are rebuilt and ordered).

    A node is a distinct sequence of first turns, the root the empty one.  ``key``: its smallest member; ``depth``;
    ``parent_<key>``: the smallest member of its parent, null for the root; ``n_convs``: members; ``n_children``;
    ``n_leaves``: nodes without children in its subtree, itself included; ``saved_tokens``: over its subtree, each
    node's members but one times the words of its last turn; ``ends_sha256``: digest of the members that end here,
    ascending and joined by commas.  All numbers are longs; a node is told by depth and smallest member.

    Null ids take no part, other nulls count as empty; equal rows are turns of their own; an empty table has no nodes, not
    even a root; further columns are ignored, whatever their names.  Ids are integers, and ``c % group`` has the sign
    of c.  Texts of any length become digests where they lie.

    Sizes: nothing collects a conversation, a node's members or a level; windows hold one band of one conversation.  A
    node that very many conversations share is joined with salts.
    """
    if band < 2:
        raise ValueError("a band has two depths at least")
    turns, convs = numbered_turns(conversations, key, turn, role, text, group, openings)
    deepest = turns.agg(F.max("depth")).first()[0] or 0
    prefixed = _prefixes(turns, deepest, band).withColumn("node", F.concat_ws(":", "depth", "prefix"))
    rows = checkpointed(prefixed.select("conv", "depth", "node", "words", "length").withColumn("salt", salt_of("conv")))
    members = rows.groupBy("node").agg(
        F.min("conv").alias("rep"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("length").alias("longest"),
        salt_mask().alias("mask"),
    )
    placed = give_back(rows, members, "node").select("conv", "depth", "rep", "n_convs", "longest", "words", "length")
    convs = checkpointed(convs)
    least, count, longest = convs.agg(F.min("conv"), F.count(F.lit(1)), F.max("length")).first()
    root = convs.select(
        "conv", F.lit(0).cast("long").alias("depth"), F.lit(least).cast("long").alias("rep"), F.lit(count).alias("n_convs"),
        F.lit(longest).cast("long").alias("longest"), F.lit(0).cast("long").alias("words"), "length",
    )
    leaf = (F.col("longest") == F.col("depth")).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("words")
    placed = checkpointed(placed.unionByName(root).withColumn("n_leaves", leaf).withColumn("saved_tokens", saved))

    values = ("n_leaves", "saved_tokens")
    totals = _rollup(placed.select("conv", "depth", "rep", *values), deepest, band, values)
    # The parent of a node is the last of its path; the first node of a band has it in the band above.
    paths = _with_path(placed.select("conv", "depth", "rep", "n_convs"), band)
    direct = F.col("top") | (F.size("path") > 0) | (F.col("depth") == 0)
    nodes = paths.filter(direct).select("depth", "rep", "n_convs", F.get("path", F.size("path") - 1).alias("parent"))
    null = F.lit(None).cast("long")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("rep"))
    lines = (
        nodes.withColumns({"n_children": null, "n_leaves": null, "saved_tokens": null})
        .unionByName(children.agg(F.count(F.lit(1)).alias("n_children")), allowMissingColumns=True)
        .unionByName(totals, allowMissingColumns=True)
    )
    whole = lines.groupBy("depth", "rep").agg(
        F.max("parent").alias("parent"), F.max("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
    )
    ends = _joined_ids(placed.filter(F.col("depth") == F.col("length")).select("depth", "rep", "conv"))
    return whole.join(ends, ["depth", "rep"], "left").select(
        F.col("rep").alias(key),
        "depth",
        F.col("parent").alias(f"parent_{key}"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
