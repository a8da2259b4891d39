"""Near copies by SimHash fingerprints that differ in few bits, found with Golay codeword indices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wortlaut.llm.components import connected
from wortlaut.llm.golay import nearby, nearest
from wortlaut.llm.shared import SALTS, checkpointed, give_back, keep_decided, salt_mask, salt_of, text_of

#: Lowest bit and width of the three segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Largest number of differing bits of a link.
BITS = 3
#: Ordered pairs of segments: the first without an error, the second with one at most.
PAIRS = tuple((a, b) for a in range(3) for b in range(3) if a != b)
_HALF = 11
_ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 65_536


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text, as a signed integer.

    A-Z in lower case; words are runs of anything but blanks; shingles of ``words`` words joined by blanks, repeats
    included (a shorter text is one shingle); a bit is set when more than half of the shingles' XXH64 (seed 42) have
    it.  Without words: zero.
    """
    tokens = (text or "").encode().translate(_ASCII_LOWER).split()
    if not tokens:
        return 0
    joined, count = b" ".join(tokens), max(1, len(tokens) - words + 1)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    ends = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, count, _BLOCK):
        spans = zip(starts[at : min(at + _BLOCK, count)].tolist(), ends[at : at + _BLOCK].tolist(), strict=True)
        hashes = b"".join([digest(joined[s:e], 42) for s, e in spans])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count).view(">i8")[0])


def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _pieces(prints: np.ndarray) -> list[np.ndarray]:
    bits = prints.astype(np.int64).view(np.uint64)
    return [((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]


def _parity(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).astype(np.int64) & 1


def _plain_keys(prints: np.ndarray) -> np.ndarray:
    """The eight keys under which a fingerprint is looked for: one per way the errors can fall."""
    parts, table = _pieces(prints), nearest()
    index = [table[p].astype(np.int64) for p in parts]
    keys = [s << 58 | parts[a] << 12 | index[b] for s, (a, b) in enumerate(PAIRS)]
    odd = _parity(parts[0]) << 2 | _parity(parts[1]) << 1 | _parity(parts[2])
    halves = (parts[0] & ((1 << _HALF) - 1), parts[0] >> _HALF)
    keys += [(6 + h) << 58 | half << 27 | index[1] << 15 | index[2] << 3 | odd for h, half in enumerate(halves)]
    return np.stack(keys, axis=1)


def _wide_keys(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) arrays: all keys under which a fingerprint meets the plain keys of those within three bits."""
    parts = _pieces(prints)
    near = [nearby(p, width) for p, (_, width) in zip(parts, SEGMENTS, strict=True)]
    for s, (a, b) in enumerate(PAIRS):
        row, column = np.nonzero(near[b] >= 0)
        yield row, s << 58 | parts[a][row] << 12 | near[b][row, column]
    odd = (1 - _parity(parts[0])) << 2 | (1 - _parity(parts[1])) << 1 | (1 - _parity(parts[2]))
    row, c1 = np.nonzero(near[1] >= 0)
    again, c2 = np.nonzero(near[2][row] >= 0)
    row, first = row[again], near[1][row, c1][again]
    second = near[2][row, c2]
    for h, half in enumerate((parts[0] & ((1 << _HALF) - 1), parts[0] >> _HALF)):
        yield row, (6 + h) << 58 | half[row] << 27 | first << 15 | second << 3 | odd[row]


def _blocks(frames: Iterator[pd.DataFrame], size: int = 4096) -> Iterator[np.ndarray]:
    for frame in frames:
        values = frame["print"].to_numpy(np.int64)
        for at in range(0, len(values), size):
            yield values[at : at + size]


def _plain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for values in _blocks(frames):
        keys = _plain_keys(values)
        yield pd.DataFrame({"key": keys.ravel(), "right": np.repeat(values, keys.shape[1])})


def _wide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for values in _blocks(frames):
        for row, key in _wide_keys(values):
            yield pd.DataFrame({"key": key, "left": values[row]})


def _way(left: Column, right: Column) -> Column:
    """The one key a pair within three bits is counted under, of all it shares."""
    errors = [
        F.bit_count(left.bitwiseXOR(right).bitwiseAND(F.lit(((1 << w) - 1) << low).cast("long")))
        for low, w in SEGMENTS[:2]
    ]
    errors.append(F.bit_count(F.shiftrightunsigned(left.bitwiseXOR(right), SEGMENTS[2][0])))
    way = F.when(
        F.bit_count(left.bitwiseXOR(right).bitwiseAND(F.lit((1 << _HALF) - 1).cast("long"))) == 0, F.lit(6)
    ).otherwise(F.lit(7))
    for s in reversed(range(len(PAIRS))):
        a, b = PAIRS[s]
        way = F.when((errors[a] == 0) & (errors[b] <= 1), F.lit(s)).otherwise(way)
    return way


def near_prints(prints: DataFrame) -> DataFrame:
    """All pairs of different fingerprints (column ``print``, distinct) that differ in at most three bits: ``left`` <
    ``right``, each pair once.

    Of three segments with at most three errors together, either one is free of errors and another has at most one,
    or each has exactly one.  A segment with at most one error is met over Golay codeword indices: the index of a word
    is among the up to six indices of the words around it.  So a key is a segment as it is with the index of another
    (33 bits); or, for one error in each, two indices, the half of the third segment that has none, and the three
    parities, which all change (38 bits).  One side of the join carries all its nearby indices (about 90 keys), the
    other only its own (8 keys), and every candidate is verified on the full fingerprints inside the join.
    """
    left, right = F.col("left"), F.col("right")
    near = (
        (F.col("left_key") == F.col("key"))
        & (left < right)
        & (F.bit_count(left.bitwiseXOR(right)) <= BITS)
        & (F.shiftright("key", 58) == _way(left, right))
    )
    wide = prints.mapInPandas(_wide, "key long, left long").withColumnRenamed("key", "left_key")
    return wide.join(prints.mapInPandas(_plain, "key long, right long"), near).select("left", "right")


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS
) -> DataFrame:
    """One row per document: ``key``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest key reachable
    over links, itself included).

    Equal fingerprints are one node, so a group of copies of any size is one row before candidates are made, and the
    links between the remaining distinct fingerprints are all found.  Null texts count as empty; empty texts share the
    fingerprint zero and are linked like any others.  A null key takes part and gets its component's smallest key
    (null when there is no other).  Repeated rows get equal results.  An empty table gives an empty result.
    """
    return _grouped(docs, key, text, salts).select(
        F.col("doc_id").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _grouped(docs: DataFrame, key: str, text: str, salts: int, *more: Column) -> DataFrame:
    """Per document: ``doc_id``, ``print``, ``root`` (the fingerprint its group is known by), ``component_id`` and the
    columns in ``more``."""
    mark = F.pandas_udf(fingerprints, "long")
    rows = checkpointed(
        docs.select(F.col(key).alias("doc_id"), mark(text_of(text)).alias("print"), *more)
        .withColumn("salt", salt_of("doc_id", salts))
    )
    nodes = checkpointed(rows.groupBy("print").agg(F.min("doc_id").alias("least"), salt_mask().alias("mask")))
    roots = connected(near_prints(nodes.select("print")), "left", "right")
    rooted = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "root", F.coalesce("root", "print")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = rooted.join(ids, "root").select("print", "mask", "root", "component_id")
    return give_back(rows, groups, "print", salts)


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One document with the smallest key of each group, with all its columns.  Documents without a key stay.

    A row is dropped for its own key and text: where a key is not unique, its texts in other groups are decided on
    their own.  Of rows in one group that repeat its smallest key, one stays, whatever their texts.
    """
    digest = F.unhex(F.sha2(text_of(text), 256))
    decided = _grouped(docs, key, text, salts, digest.alias("_digest")).select(
        F.col("doc_id").alias("_key"),
        "_digest",
        F.col("root").alias("_group"),
        (F.col("doc_id") == F.col("component_id")).alias("_kept"),
    )
    return keep_decided(docs, decided, key, digest)
