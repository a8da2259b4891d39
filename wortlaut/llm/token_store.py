"""Token ids in binary shards, with a minimal perfect hash from document keys to places in the payload."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wortlaut.llm.encode import Encoder
from wortlaut.llm.perfect_hash import PerfectHash, fingerprint
from wortlaut.llm.shared import checkpointed

MAGIC = b"WLTOKENS"
#: A shard is closed once it has so many ids.
SHARD_IDS = 8_000_000
_READ_AT_ONCE = 4_000_000
_MANIFEST = (
    ("task", "int"), ("shard", "int"), ("path", "string"), ("docs", "long"), ("ids", "long"), ("first_key", "long"),
    ("last_key", "long"),
)
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def shard_bytes(keys: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """The file format, all numbers little-endian:

    magic (8 bytes), length of the header (u4), header (JSON: counts, id width, level sizes of the hash, and the byte
    offset of each section after the header), then the sections: ``payload`` (all ids in document order, nothing
    between), ``ends`` (i8 per document: ids up to its end), ``keys`` (i8), ``known`` (u1: 0 for a null key), ``bits``
    (the hash), and by the number the hash gives a key: ``prints`` (u4 fingerprint) and ``rows`` (u4 document).
    """
    known = np.array([k is not None for k in keys], np.uint8)
    values = np.array([k if k is not None else 0 for k in keys], np.int64)
    rows = np.flatnonzero(known)
    distinct, first = np.unique(values[rows], return_index=True)
    hashed = PerfectHash.build(distinct.view(np.uint64))
    place = hashed.number(distinct.view(np.uint64))
    prints, slots = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    prints[place], slots[place] = fingerprint(distinct.view(np.uint64)), rows[first]
    ends = np.cumsum([len(x) for x in ids], dtype="<i8")
    sections = {
        "payload": np.concatenate(ids) if ids else np.empty(0, f"<u{width}"),
        "ends": ends, "keys": values.astype("<i8"), "known": known, "bits": hashed.bits, "prints": prints, "rows": slots,
    }
    parts, offsets, at = [], {}, 0
    for name, data in sections.items():
        raw = data.tobytes()
        offsets[name] = at
        padding = -len(raw) % 8
        parts += [raw, bytes(padding)]
        at += len(raw) + padding
    header = {"docs": len(keys), "ids": int(ends[-1]) if len(ends) else 0, "width": width, "distinct": len(distinct),
              "levels": hashed.sizes, "bits": len(hashed.bits), "offsets": offsets}
    text = json.dumps(header).encode()
    return b"".join([MAGIC, len(text).to_bytes(4, "little"), text, *parts])


class Shard:
    """One shard file, read in place: the index is loaded, payload slices are read when asked for."""

    def __init__(self, path: str):
        system, name = _open(path)
        self.file = system.open_input_file(name)
        start = self.file.read_at(12, 0)
        if start[:8] != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        length = int.from_bytes(start[8:], "little")
        self.header = json.loads(self.file.read_at(length, 12))
        self._base = 12 + length
        docs, distinct = self.header["docs"], self.header["distinct"]
        self.dtype = np.dtype(f"<u{self.header['width']}")
        self.ends = np.concatenate([[0], self._section("ends", "<i8", docs)])
        self.keys = self._section("keys", "<i8", docs)
        self.known = self._section("known", "u1", docs).astype(bool)
        self.prints = self._section("prints", "<u4", distinct)
        self.rows = self._section("rows", "<u4", distinct).astype(np.int64)
        self.hash = PerfectHash.of(self.header["levels"], self._section("bits", "<u8", self.header["bits"]))

    def _section(self, name: str, dtype: str, count: int) -> np.ndarray:
        size = np.dtype(dtype).itemsize * count
        return np.frombuffer(self.file.read_at(size, self._base + self.header["offsets"][name]), dtype)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The (first) document of each key, or -1: one hash, one fingerprint, one comparison of the key."""
        keys = keys.astype(np.int64)
        if not len(self.rows):
            return np.full(len(keys), -1, np.int64)
        place = self.hash.number(keys.view(np.uint64))
        rows = self.rows[place]
        good = (place >= 0) & (self.prints[place] == fingerprint(keys.view(np.uint64)))
        return np.where(good & self.known[rows] & (self.keys[rows] == keys), rows, -1)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of documents ``first`` up to but without ``last``."""
        start, end = int(self.ends[first]), int(self.ends[last])
        at = self._base + self.header["offsets"]["payload"] + start * self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - start) * self.dtype.itemsize, at), self.dtype)

    def close(self) -> None:
        self.file.close()


@dataclass
class TokenStore:
    """Shards of one write: ``manifest`` has a line per shard (``path``, ``docs``, ``ids``, ``first_key``,
    ``last_key``, and ``start``: the ids in all shards before)."""

    manifest: DataFrame

    @classmethod
    def write(
        cls, docs: DataFrame, folder: str, tokenizer: str, end_id: int,
        key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS,
    ) -> TokenStore:
        """Encode every whole text, add ``end_id``, and write the ids in ascending order of the (integer) key.

        Documents are sorted across the cluster; each task writes the shards of its range.  A shard's file has a name
        of its own per attempt and counts only once the task's manifest line is kept, so a lost or repeated task
        leaves at most a file that nobody refers to.  The folder must be one that all executors see.

        Null texts are empty (one end id); null keys come first and are not indexed; rows that repeat a key stand
        next to each other and the index leads to the first.  An empty table writes nothing.
        """
        spark = docs.sparkSession
        _make_folder(spark, folder)

        def write_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, task, shard = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
            dtype = encoder.dtype if end_id < 1 << 8 * encoder.dtype.itemsize else np.dtype("<u4")
            end, keys, ids, size = np.array([end_id], dtype), [], [], 0

            def flush() -> pa.RecordBatch:
                path = f"{folder.rstrip('/')}/{task:06d}-{shard:06d}-{uuid.uuid4().hex}.tok"
                system, name = _open(path)
                with system.open_output_stream(name) as out:
                    out.write(shard_bytes(keys, ids, dtype.itemsize))
                known = [k for k in keys if k is not None]
                line = (task, shard, path, len(keys), size, min(known, default=None), max(known, default=None))
                columns = [pa.array([x], _ARROW[kind]) for x, (_, kind) in zip(line, _MANIFEST, strict=True)]
                return pa.RecordBatch.from_arrays(columns, [name for name, _ in _MANIFEST])

            for batch in batches:
                for k, found in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                    keys.append(k)
                    ids.append(np.concatenate([found.astype(dtype, copy=False), end]))
                    size += len(ids[-1])
                    if size >= shard_ids:
                        yield flush()
                        keys, ids, size, shard = [], [], 0, shard + 1
            if keys:
                yield flush()

        order = F.col("key").asc_nulls_first()
        rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        schema = ", ".join(map(" ".join, _MANIFEST))
        lines = rows.repartitionByRange(order).sortWithinPartitions(order, "text").mapInArrow(write_shards, schema)
        before = Window.orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start")
        return cls(checkpointed(lines).select("*", start))

    def summary(self) -> DataFrame:
        """Per document, read back through the index: ``key``, ``start`` (ids of all documents before it),
        ``n_tokens``, ``ids_crc32`` (of its ids as unsigned 32-bit numbers)."""

        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for path, start in zip(frame["path"], frame["start"], strict=True):
                    shard = Shard(path)
                    yield from _documents(shard, int(start))
                    shard.close()

        # as many tasks as shards: the lines are short, the payloads behind them are not
        lines = self.manifest.select("path", "start").repartition(max(1, self.manifest.count()), "path")
        return lines.mapInPandas(read, "key long, start long, n_tokens long, ids_crc32 long")

    def fetch(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """The ids of the asked keys: ``key``, ``ids``.  Keys the store doesn't have give no row; a key that was
        written more than once gives its first row of each shard that has it.

        The list of shards (two numbers and a path each) is read by the driver to lead keys to shards.
        """
        lines = self.manifest.filter("first_key is not null").orderBy("task", "shard")
        lines = lines.select("path", "first_key", "last_key").collect()
        paths = [r.path for r in lines]
        first = np.array([r.first_key for r in lines], np.int64)
        last = np.array([r.last_key for r in lines], np.int64)

        @F.pandas_udf("array<string>")
        def shards_of(asked: pd.Series) -> pd.Series:
            values = asked.to_numpy(np.int64)
            low, high = np.searchsorted(last, values, "left"), np.searchsorted(first, values, "right")
            return pd.Series([paths[a:b] for a, b in zip(low, high, strict=True)], dtype=object)

        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for path, group in frame.groupby("path"):
                    shard = Shard(path)
                    asked = group["key"].to_numpy(np.int64)
                    rows = shard.find(asked)
                    found = [(k, shard.ids(r, r + 1).tolist()) for k, r in zip(asked, rows, strict=True) if r >= 0]
                    shard.close()
                    yield pd.DataFrame(found, columns=["key", "ids"])

        asked = keys.select(F.col(key).cast("long").alias("key")).filter("key is not null").distinct()
        routed = asked.withColumn("path", F.explode(shards_of("key"))).repartition("path").sortWithinPartitions("path")
        return routed.mapInPandas(read, "key long, ids array<long>")


def _documents(shard: Shard, start: int) -> Iterator[pd.DataFrame]:
    """All documents of a shard, each looked up by its key, in blocks of payload."""
    docs = shard.header["docs"]
    rows, known = np.arange(docs), shard.known
    found = rows.copy()
    found[known] = shard.find(shard.keys[known])
    if (found < 0).any():
        raise ValueError("a key is not in the index of its shard")
    repeat = known & (found != rows)  # rows that repeat a key follow the first of it
    at = 0
    while at < docs:
        stop = max(at + 1, int(np.searchsorted(shard.ends, shard.ends[at] + _READ_AT_ONCE, "right")) - 1)
        block, base = shard.ids(at, stop), shard.ends[at]
        place = np.where(repeat[at:stop], rows[at:stop], found[at:stop])
        starts, ends = shard.ends[place], shard.ends[place + 1]
        sums = [zlib.crc32(block[a - base : b - base].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
        keys = pd.Series(shard.keys[at:stop], dtype="Int64").mask(~known[at:stop])
        yield pd.DataFrame({"key": keys, "start": starts + start, "n_tokens": ends - starts, "ids_crc32": sums})
        at = stop


def _make_folder(spark: SparkSession, folder: str) -> None:
    system, name = _open(folder)
    system.create_dir(name, recursive=True)
