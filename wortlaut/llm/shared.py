"""Expressions and helpers that several operators of this folder share."""

from __future__ import annotations

import string
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but blanks and the control characters that break lines or columns.
WORD = r"[^\x20\x09-\x0D]+"

#: A group of copies is dealt into so many parts, so that no task meets a whole hot group.
SALTS = 16


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is.  ``lower`` does just that to a text of single bytes, and faster."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc32_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(column: str = "doc_id", folds: int = 5) -> Column:
    """Rows no model learns from: one fold, by the checksum of the id.  A null id is never held out."""
    return F.coalesce(crc32_of_id(column) % folds == 0, F.lit(False))


def salt_of(column: str = "doc_id", salts: int = SALTS) -> Column:
    """The part of its group that a row belongs to."""
    if not 1 <= salts <= 63:  # they are bits of a long
        raise ValueError("1 to 63 salts")
    return F.pmod(F.xxhash64(F.col(column)), F.lit(salts)).cast("int")


def salt_mask(salt: str = "salt") -> Column:
    """An aggregate: the salts of a group as bits of one long, of fixed width and so fit for hash aggregation."""
    return F.expr(f"bit_or(shiftleft(1L, `{salt}`))")


def give_back(rows: DataFrame, groups: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """Join each row (``key``, ``salt``) with its group (``key``, ``mask`` of the salts its rows have).

    The group's line is repeated once per salt in use, so the rows of a hot group meet it in up to ``salts`` tasks.
    """
    used = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit(F.col("mask"), s) == 1)
    lines = groups.withColumn("salt", F.explode(used)).drop("mask")
    return rows.join(lines, [key, "salt"]).drop("salt")


def keep_decided(docs: DataFrame, decided: DataFrame, key: str, digest: Column, repeats: bool = False) -> DataFrame:
    """The documents that stay, with all their columns, by the decisions in ``decided``: one line per document with
    ``_key``, ``_digest`` (of its text), ``_group`` and ``_kept``.

    A decision holds for the rows of its key and digest, so a key that is not unique keeps its other texts.  Without
    ``repeats``, one row stays of those with the key that won a group: the smallest digest, and any one of the rows
    that repeat it.  Documents without a key are never dropped.
    """
    decided = checkpointed(decided.filter(F.col("_key").isNotNull()))
    rows = docs.select(F.struct("*").alias("_doc"), F.col(key).alias("_key"), digest.alias("_digest"))
    dropped, kept = decided.filter(~F.col("_kept")).select("_key", "_digest"), decided.filter("_kept")
    if repeats or kept.groupBy("_key").count().filter("count > 1").isEmpty():
        return rows.join(dropped.distinct(), ["_key", "_digest"], "left_anti").select("_doc.*")
    counted = kept.groupBy("_group", "_key", "_digest").agg(F.count(F.lit(1)).alias("_n"))
    first = counted.groupBy("_group", "_key").agg(F.min(F.struct("_digest", "_n")).alias("_first"))
    others = counted.join(first, ["_group", "_key"]).filter("_digest != _first._digest").select("_key", "_digest")
    twins = checkpointed(first.filter("_first._n > 1").select("_key", "_first._digest"))
    rest = rows.join(dropped.unionByName(others).distinct(), ["_key", "_digest"], "left_anti")
    single = rest.join(twins, ["_key", "_digest"], "left_anti")
    one = rows.join(twins, ["_key", "_digest"], "left_semi").dropDuplicates(["_key", "_digest"])
    return single.unionByName(one).select("_doc.*")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a new temporary one only in a local session where none is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="run-checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows computed once and kept where all executors read them; Spark's cleaner removes them with the frame."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def repeat_rows(df: DataFrame, times: str, block: int = 65_536) -> DataFrame:
    """Each row as often as its column ``times`` says, in blocks, so that no array outgrows ``block`` entries."""
    blocks = F.explode(F.expr(f"sequence(0, (`{times}` - 1) div {block})"))
    inside = F.explode(F.expr(f"sequence(1, least({block}, `{times}` - _block * {block}))"))
    return (
        df.filter(F.col(times) > 0).withColumn("_block", blocks).withColumn("_copy", inside).drop("_block", "_copy")
    )


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """Something made once in a Python worker and found again by its later tasks, like a loaded vocabulary.  Task code
    travels by value, so module globals would be new for every task."""
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]
