"""Filters by the values of another table, and folders for tables that are written and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def keep_values(table: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among the values of ``wanted``; nulls there match nothing."""
    return table.join(wanted.select(column).dropna().distinct(), column, "left_semi").select(*table.columns)


def _checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in a local session where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-staged-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession) -> str:
    """A new path in the checkpoint folder, which goes when the session's driver ends."""
    path = f"{_checkpoint_dir(spark).rstrip('/')}/wortlaut-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder once and read from there with their size known."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
