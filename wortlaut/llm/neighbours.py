"""Approximate nearest neighbours with a hash-prefix forest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wortlaut.llm.hash_forest import HashFamily, HashForest
from wortlaut.llm.shared import checkpointed

#: Vectors of one block; queries that are worked on at once; tasks at most (a task may hold several blocks).
BLOCK_ROWS, QUERIES_AT_ONCE, MOST_TASKS = 8_192, 512, 20_000
#: Bands of lengths per doubling: the vectors of a block have nearly the same length, so lifting them costs little.
_BANDS = 4


def _usable(table: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """``id``, ``v`` of the rows that take part, each pair once."""
    v = F.col(vector).cast(f"array<{kind}>")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    taking_part = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = table.select(F.col(key).alias("id"), v.alias("v"))
    return rows.filter(F.col("id").isNotNull() & taking_part).dropDuplicates(["id", "v"])


def _classes(rows: DataFrame, members: int) -> DataFrame:
    """Equal vectors are one class, numbered ``cls``; of each the ``members`` smallest ids, the first at ``place`` 1.

    More can't be among the nearest of any query.  Spark cuts the groups before the shuffle, so a hot one stays small.
    """
    same = Window.partitionBy("v")
    least = rows.withColumn("place", F.row_number().over(same.orderBy("id"))).filter(F.col("place") <= members)
    numbered = least.withColumn("cls", F.monotonically_increasing_id())
    return checkpointed(numbered.withColumn("cls", F.min("cls").over(same)))


def _band(v: str = "v") -> Column:
    """Which band of lengths a vector belongs to; 1 lies inside a band."""
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.floor(F.log2(F.greatest(square, F.lit(1e-300))) / 2 * _BANDS + 0.5).cast("int")


def _search(
    rows: DataFrame, blocks: int, family: Callable[[int], HashFamily], k: int, confidence: float, last: bool
) -> DataFrame:
    """Run every block's queries through its forest.

    ``rows`` are the vectors (kind 0) and queries (kind 1) of all blocks.  They are dealt by block and sorted, so a task
    reads a block's vectors, builds the forest, and then lets the queries stream by: it never holds more than a block
    and some queries.  The first pass gives the best classes among the longest matches, the last pass those of the
    ascent that reach the query's floor; per query and block ``k`` + 1 at most.
    """
    dealt = rows.repartitionById(min(blocks, MOST_TASKS), F.col("block").cast("int")).sortWithinPartitions("block", "kind")

    def matrix(column: pa.ListArray) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(column), -1)

    def answered(forest: HashForest, first: np.ndarray, cls: np.ndarray, asked: pa.RecordBatch) -> pa.RecordBatch:
        numbers, queries = asked.column("number").to_numpy(), matrix(asked.column("v"))
        strings = forest.family.strings(queries)
        if last:
            floors = asked.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
            lengths = np.linalg.norm(queries, axis=1)
            marks = forest.ascend(strings, lengths, floors, confidence)
            floors = np.where(np.isnan(floors), -np.inf, floors - 1e-9 * lengths * forest.longest)
        else:
            marks = forest.descend(strings, 20 * k, k + 1)
            floors = np.full(len(queries), -np.inf)
        out = []
        for query, number, floor, marked in zip(queries, numbers, floors, marks, strict=True):
            near = np.flatnonzero(marked)
            scores = forest.vectors[near] @ query
            keep = scores >= floor
            if keep.sum() > k + 1:
                keep &= scores >= np.partition(scores, -(k + 1))[-(k + 1)]
            near, scores = near[keep], scores[keep]
            best = np.lexsort((first[near], -scores))[: k + 1]
            out.append((np.full(best.size, number), cls[near[best]], first[near[best]], scores[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "cls", "first", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, forest, first, cls = None, [], None, None, None
        for batch in batches:
            marks = np.stack([batch.column("block").to_numpy(), batch.column("kind").to_numpy()])
            starts = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)]) if batch.num_rows else []
            for start, stop in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                part = batch.slice(start, stop - start)
                if marks[0, start] != block:
                    block, waiting, forest = marks[0, start], [], None
                if marks[1, start] == 0:
                    waiting.append(part)
                    continue
                if forest is None and not waiting:
                    continue
                if forest is None:
                    held = pa.Table.from_batches(waiting).combine_chunks()
                    vectors = matrix(held.column("v").chunk(0))
                    forest, waiting = HashForest(vectors, family(vectors.shape[1])), []
                    first, cls = held.column("first").to_numpy(), held.column("number").to_numpy()
                for i in range(0, part.num_rows, QUERIES_AT_ONCE):
                    yield answered(forest, first, cls, part.slice(i, QUERIES_AT_ONCE))

    return dealt.mapInArrow(run, "query long, cls long, first long, score double")


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    trees: int = 96,
    bits: int = 48,
    pool: int = 512,
    confidence: float = 0.95,
    block_rows: int = BLOCK_ROWS,
    seed: int = 13,
) -> DataFrame:
    """The ``k`` nearest vectors found for each query: ``query_id``, ``rank`` (from 1), ``key``, ``score``.

    Nearness is the inner product in double precision of the original vectors.  Every vector is hashed to ``trees``
    strings of ``bits`` bits, kept in sorted arrays.  A query descends to its longest matching prefixes and ascends in
    all trees together until it has enough candidates; the best scores of all blocks give a floor under its k-th best
    score.  A second ascent then goes on until a vector as near as the floor would be missed with a probability of at
    most 1 - ``confidence``, so what is looked at follows the data, not a fixed number: recall is about the
    confidence at any size, and no bucket is capped.  Every candidate's score is computed exactly.

    Rows of ``vectors`` are indexed in blocks of about ``block_rows`` vectors of nearly equal length; they are moved
    once per pass, and the queries go to each block.  Equal vectors are searched once and stand for all their ids.

    Ids are integers.  A row's own id is no candidate of its query; ties go to the smaller id.  Rows with a null id,
    or a vector that is null, empty, zero or holds null or non-finite components, take no part.  Vectors meet only
    vectors of the same number of components.  Repeated rows count once; an id with several vectors asks with each and
    is found by its best (its own vectors take places among the nearest before they are left out, so it may get fewer).
    A query without any candidate has no rows; an empty table gives an empty table.  Further columns are ignored.  Components beyond 1e150 in size, whose squares overflow, are not supported.
    """
    single = all(isinstance(t.schema[vector].dataType.elementType, T.FloatType) for t in (queries, vectors))
    kind = "float" if single else "double"
    held = _classes(_usable(vectors, key, vector, kind), k + 1)
    index = held.filter("place = 1").select(F.col("cls").alias("number"), F.col("id").cast("long").alias("first"), "v")
    index = index.withColumn("dim", F.size("v")).withColumn("band", _band())
    # One line per number of components and band of lengths.
    bands = index.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("parts"))
    before = Window.orderBy("dim", "band").rowsBetween(Window.unboundedPreceding, -1)
    bands = checkpointed(bands.withColumn("start", F.coalesce(F.sum("parts").over(before), F.lit(0)).cast("long")))
    blocks = bands.agg(F.sum("parts")).first()[0] or 1
    placed = index.join(bands, ["dim", "band"]).select(
        (F.col("start") + F.pmod(F.xxhash64("number"), F.col("parts"))).alias("block"),
        F.lit(0).alias("kind"), "number", "first", "v", F.lit(None).cast("double").alias("floor"),
    )

    asking = checkpointed(_usable(queries, key, vector, kind))
    asked = checkpointed(asking.select("v").distinct().withColumn("query", F.monotonically_increasing_id()))
    made: dict[int, HashFamily] = {}

    def family(dim: int) -> HashFamily:
        if dim not in made:
            made.clear()
            made[dim] = HashFamily(dim, trees, bits, pool, seed)
        return made[dim]

    def searched(floors: DataFrame, last: bool) -> DataFrame:
        sent = floors.withColumn("dim", F.size("v")).join(bands, "dim")
        sent = sent.withColumn("block", F.explode(F.sequence("start", F.col("start") + F.col("parts") - 1)))
        sent = sent.select("block", F.lit(1).alias("kind"), F.col("query").alias("number"), F.lit(None).cast("long").alias("first"), "v", "floor")
        return _search(placed.unionByName(sent), blocks, family, k, confidence, last)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "first")
        return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)

    longest = checkpointed(best(searched(asked.withColumn("floor", F.lit(None).cast("double")), last=False)))
    floors = longest.filter(F.col("n") == k + 1).select("query", F.col("score").alias("floor"))
    climbed = searched(asked.join(floors, "query", "left"), last=True)
    both = climbed.unionByName(longest.drop("n")).groupBy("query", "cls", "first").agg(F.max("score").alias("score"))
    found = best(both)
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "id")

    each = found.join(held.select("cls", "id"), "cls").groupBy("query", "id").agg(F.max("score").alias("score"))
    each = each.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    asks = asking.join(asked, "v").select(F.col("id").alias("query_id"), "query")
    own = asks.join(each, "query").filter(F.col("query_id") != F.col("id"))
    own = own.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
