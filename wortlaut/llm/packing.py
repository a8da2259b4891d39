"""Packing documents into as few sequences as possible: linear grouping of lengths, then best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wortlaut.llm.encode import Encoder
from wortlaut.llm.shared import checkpointed

CAPACITY = 4096
#: Groups of equal cardinality that large lengths are rounded up in, and the share of a sequence that is large.
GROUPS, LARGE = 1024, 1 / 16
#: Pieces of one length are numbered in so many parts, so that no window holds a whole hot length.
PARTS = 64

_PIECES = "piece int, start long, length long, ids_crc32 long"
Run = tuple[int, int, int, int, int]


def cut_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode whole texts, add ``end_id`` and cut what is longer than ``capacity``: a row per piece, without its ids."""
    if capacity < 1:
        raise ValueError("a sequence must hold at least one token")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for n, found in enumerate(encoder.encode(batch.column(1))):
                ids = np.concatenate([found.astype("<u4"), end])
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((n, piece, at, len(part), zlib.crc32(part.tobytes())))
            row, *numbers = zip(*rows, strict=True) if rows else [()] * 5
            keys = batch.column(0).take(pa.array(row, pa.int64()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [keys, *(pa.array(c, k) for c, k in zip(numbers, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, [key, "piece", "start", "length", "ids_crc32"])

    slim = docs.select(key, F.col(text).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    return slim.mapInArrow(cut, f"`{key}` {kind}, {_PIECES}")


def _grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> tuple[list[int], list[int]]:
    """Linear grouping of lengths in descending order: the size each group is rounded up to, and its cardinality."""
    total = int(counts.sum())
    per = -(-total // groups)
    ends = np.cumsum(counts)
    sizes = [int(lengths[np.searchsorted(ends, at, "right")]) for at in range(0, total, per)]
    return sizes, [min(per, total - at) for at in range(0, total, per)]


def _best_fill(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How often each size (in descending order) is taken, at most ``left`` times, so that ``room`` is filled best."""
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    by = np.full(room + 1, -1, np.int64)
    for g, (size, n) in enumerate(zip(sizes, left, strict=True)):
        if size > room or not n:
            continue
        new = reached
        for _ in range(min(n, room // size)):
            step = np.zeros(room + 1, bool)
            step[size:] = new[:-size]
            new = step & ~reached
            if not new.any():
                break
            by[new] = g
            reached = reached | new
        if reached[room]:
            break
    taken, at = [0] * len(sizes), int(np.flatnonzero(reached)[-1])
    while at:
        taken[by[at]] += 1
        at -= sizes[by[at]]
    return taken


def _configurations(sizes: list[int], counts: list[int], capacity: int) -> Iterator[tuple[int, list[int]]]:
    """(how often, sizes by group) until every group is used up; each holds the largest size that is left and is
    filled as well as the remaining sizes allow, and is used as often as they last."""
    left, first = list(counts), 0
    while True:
        while first < len(left) and not left[first]:
            first += 1
        if first == len(left):
            return
        left[first] -= 1
        taken = _best_fill(sizes[first:], left[first:], capacity - sizes[first])
        left[first] += 1
        taken[0] += 1
        taken = [0] * first + taken
        times = min(left[g] // n for g, n in enumerate(taken) if n)
        for g, n in enumerate(taken):
            left[g] -= n * times
        yield times, taken


def plan_sequences(
    counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE
) -> tuple[list[Run], int]:
    """Where pieces go, from the number of pieces of each length alone: runs (length, first, n, sequence, offset) and
    the number of sequences.  The pieces of a length numbered ``first`` … ``first + n - 1`` go, one each, to ``n``
    consecutive sequences from ``sequence`` on, all at ``offset``.

    Large lengths, in descending order, are rounded up within groups of equal cardinality; configurations of the few
    rounded sizes are chosen by an exact subset sum; actual pieces take the places, and their actual lengths decide
    how much room is left.  Small lengths then go, longest first, where they fit best.  The work and the number of
    runs depend on ``capacity`` and ``groups``, not on the number of documents.
    """
    runs: list[Run] = []
    sequences = counts.get(capacity, 0)
    if sequences:
        runs.append((capacity, 0, sequences, 0, 0))
    limit = max(1, int(capacity * large))
    lengths = np.array(sorted((n for n in counts if limit <= n < capacity and counts[n] > 0), reverse=True), np.int64)
    room: dict[int, list[list[int]]] = {}

    def leave(space: int, at: int, n: int) -> None:
        if space and n:
            if space not in room:
                insort(spaces, space)
            room.setdefault(space, []).append([at, n])

    spaces: list[int] = []
    if len(lengths):
        amounts = np.array([counts[int(n)] for n in lengths], np.int64)
        ends = np.cumsum(amounts)
        begins = ends - amounts
        sizes, cardinal = _grouped(lengths, amounts, groups)
        next_of = (np.cumsum(cardinal) - cardinal).tolist()
        for times, taken in _configurations(sizes, cardinal, capacity):
            slots = []
            for g, n in enumerate(taken):
                for _ in range(n):
                    slots.append(next_of[g])
                    next_of[g] += times
            done = 0
            while done < times:  # the stretch in which no place changes to the next actual length
                here = [int(np.searchsorted(ends, p + done, "right")) for p in slots]
                stretch = min(times - done, *(int(ends[i]) - p - done for i, p in zip(here, slots, strict=True)))
                offset = 0
                for i, p in zip(here, slots, strict=True):
                    runs.append((int(lengths[i]), p + done - int(begins[i]), stretch, sequences + done, offset))
                    offset += int(lengths[i])
                leave(capacity - offset, sequences + done, stretch)
                done += stretch
            sequences += times
    for length in sorted((n for n in counts if n < limit and counts[n] > 0), reverse=True):
        first, left = 0, counts[length]
        while left:
            best = bisect_left(spaces, length)
            if best == len(spaces):
                fresh = -(-left * length // capacity)
                leave(capacity, sequences, fresh)
                sequences += fresh
                continue
            space = spaces[best]
            at, n = room[space][-1]
            used = min(n, left)
            runs.append((length, first, used, at, capacity - space))
            if used < n:
                room[space][-1] = [at + used, n - used]
            else:
                room[space].pop()
                if not room[space]:
                    del room[space], spaces[best]
            leave(space - length, at, used)
            first, left = first + used, left - used
    return runs, sequences


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text",
    parts: int = PARTS,
) -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    The driver sees one number per length (at most ``capacity`` of them) and plans on these.  Pieces of one length are
    numbered part by part, so a hot length is nobody's whole task, and meet the plan over their length and number.

    Null texts are empty: one piece with the end id.  Null keys, repeated keys and repeated rows are packed like any
    others.  An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = checkpointed(cut_pieces(docs, tokenizer, end_id, capacity, key, text))
    part = F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(parts)).cast("int")
    pieces = pieces.withColumn("_part", part)
    counted = checkpointed(pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")))
    counts = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs, _ = plan_sequences(counts, capacity)

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counted.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    inside = Window.partitionBy("length", "_part").orderBy(key, "piece", "ids_crc32")
    numbered = (
        pieces.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(begins, ["length", "_part"])
        .withColumn("_number", F.col("_begin") + F.col("_inside"))
    )
    plan = spark.createDataFrame(
        pd.DataFrame(runs, columns=["_length", "_first", "_n", "_sequence", "offset"], dtype="int64"),
        "_length long, _first long, _n long, _sequence long, offset long",
    )
    number, first = F.col("_number"), F.col("_first")
    fits = (F.col("length") == F.col("_length")) & (number >= first) & (number < first + F.col("_n"))
    # the plan's size is bounded by the capacity
    return numbered.join(F.broadcast(plan), fits).select(
        key, "piece", "start", "length", "ids_crc32", (F.col("_sequence") + number - first).alias("sequence_id"), "offset"
    )
