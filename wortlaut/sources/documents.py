"""Document sources: XML files, archives, and tables that already hold documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of an upload, in bytes.
MAX_ARCHIVE_BYTES = 100 * 1024 * 1024
MAX_FILE_BYTES = 50 * 1024 * 1024

_SNIFF_BYTES = 100
# What bytes.lstrip() removes.
_LEADING = r"^[ \t\n\r\x0b\f]*"


def looks_like_xml(content: Column, strict: bool = False) -> Column:
    """The first 100 bytes, without leading white space, begin with '<'.

    A byte order mark in front is accepted unless ``strict``.
    """
    mark = "" if strict else r"(?:\xEF\xBB\xBF)?"
    # latin-1 keeps one character per byte, so the test works on bytes
    head = F.decode(F.substring(content, 1, _SNIFF_BYTES), "ISO-8859-1")
    return head.rlike(_LEADING.replace("^", "^" + mark, 1) + "<")


def size_kb(length: Column) -> Column:
    """Bytes as kilobytes with two decimals."""
    return F.bround(length / 1024, 2)


def with_location(df: DataFrame, path: Column) -> DataFrame:
    """Add doc_id, subdir and filename from a path relative to the corpus root."""
    subdir = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return df.withColumns(
        {
            "doc_id": path,
            "subdir": F.when(subdir == "", F.lit(".")).otherwise(subdir),
            "filename": F.element_at(F.split(path, "/"), -1),
        }
    )


def _documents(files: DataFrame, ord_col: str | None = None) -> DataFrame:
    order = F.col(ord_col) if ord_col else F.col("doc_id")
    return files.select(
        "doc_id", order.alias("doc_ord"), "subdir", "filename", size_kb(F.length("content")).alias("size_kb"), "content"
    )


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path relative to the root, length, content) of all files below a directory whose names match ``glob``."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    return found.select(_relative(spark, path, F.col("path")).alias("path"), "length", "content")


def _relative(spark: SparkSession, root: str, path: Column) -> Column:
    """The part of a file's full path below the directory that was read."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop_path).toString()
    return F.substring(path, len(full.rstrip("/")) + 2, 1 << 30)


def scan_records(spark: SparkSession, path: str, end: str, glob: str = "*.xml") -> DataFrame:
    """What stands in files up to each ``end``, which is left out: ``doc_id``, ``split``, ``place``, ``value`` (bytes),
    ``size`` (of the file).

    Files of any size are read in splits (``spark.sql.files.maxPartitionBytes``); a record belongs to the split in which
    it begins.  ``split`` is the split's first byte, and ``place`` grows with the records of a split.  Of every file, the
    record after the last ``end`` is the last one.
    """
    found = (
        spark.read.option("lineSep", end)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(path)
        .select("value", *(F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_size")))
    )
    return found.select(
        _relative(spark, path, F.col("file_path")).alias("doc_id"), F.col("file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("value"),
        F.col("file_size").alias("size"),
    )


def scan_corpus(spark: SparkSession, path: str, glob: str = "*.xml", strict_sniff: bool = False) -> DataFrame:
    """The document table of a directory tree: every file matching ``glob`` that looks like XML.

    Documents are ordered by path.  Files are packed into partitions by size as Spark does for any scan; unreadable
    files are skipped when ``spark.sql.files.ignoreCorruptFiles`` is set.
    """
    files = with_location(scan_files(spark, path, glob), F.col("path"))
    return _documents(files.filter(looks_like_xml(F.col("content"), strict_sniff)))


def docs_from_table(table: DataFrame, path: Column, content: Column, order: Column | None = None) -> DataFrame:
    """The document table of a table that holds one document per row."""
    rows = table.select(
        path.alias("path"), content.cast("binary").alias("content"), (path if order is None else order).alias("ord")
    )
    return _documents(with_location(rows, F.col("path")), "ord")


def spread(rows: DataFrame, key: str, partitions: int) -> DataFrame:
    """Deal rows out to ``partitions`` tasks.  Parsing costs far more than reading, so this pays for input in few splits;
    the caller knows whether it is."""
    return rows.repartition(partitions, key)


def _members(name: str, data: bytes | None, max_bytes: int) -> list[tuple]:
    """(archive, error, path, content) of the XML members of one ZIP file, or one row with its error."""
    rows, total = [], 0
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as archive:
            for info in archive.infolist():
                member = info.filename
                if ".." in member or member[:1] in ("/", "\\"):
                    continue
                total += info.file_size
                if total > max_bytes:
                    return [(name, "too large", None, None)]
                if member.lower().endswith(".xml"):
                    rows.append((name, None, member, archive.read(info)))
    except Exception:  # whatever is wrong with one archive, the others go on
        return [(name, "bad archive", None, None)]
    return rows


def _arrow(rows: list[tuple], **fields: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values())], names=list(fields))


def expand_archives(archives: DataFrame, max_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """XML members of ZIP files: ``(path, content)`` → one row per member, or one row with ``archive_error``.

    Names that leave the archive are skipped.  An archive whose members, by declared size and in order, exceed
    ``max_bytes`` fails, as does a damaged one; members that do not look like XML are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content")):
                # one batch per archive, whose size is limited
                rows = _members(name.as_py(), data.as_py(), max_bytes)
                yield _arrow(
                    rows, archive=pa.string(), archive_error=pa.string(), path=pa.string(), content=pa.binary()
                )

    schema = "archive string, archive_error string, path string, content binary"
    rows = archives.select("path", "content").mapInArrow(run, schema)
    return rows.filter(F.col("archive_error").isNotNull() | looks_like_xml(F.col("content"), strict=True))


def archive_docs(members: DataFrame) -> DataFrame:
    """Document table of expanded archives; each archive is a directory of its own."""
    good = members.filter(F.col("archive_error").isNull())
    return _documents(with_location(good, F.concat_ws("/", "archive", "path")))


def intake_report(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, size_kb, status) for incoming files ``(path, content)``.

    Statuses: accepted, too_large, not_xml, bad_archive, archive_too_large, ignored (another kind of file).
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column("path"), batch.column("content")):
                failed = next((error for _, error, *_ in _members(name.as_py(), data.as_py(), MAX_ARCHIVE_BYTES)), None)
                status = {"bad archive": "bad_archive", "too large": "archive_too_large"}.get(failed, "accepted")
                rows.append((name.as_py(), len(data.as_py()), status))
            yield _arrow(rows, path=pa.string(), size=pa.int64(), status=pa.string())

    name, size = F.lower("path"), F.length("content").cast("long")
    is_archive = name.endswith(".zip") & (size <= max_bytes)
    packed = files.filter(is_archive).select("path", "content").mapInArrow(check, "path string, size long, status string")
    status = (
        F.when(size > max_bytes, "too_large")
        .when(~name.endswith(".xml"), "ignored")
        .when(looks_like_xml(F.col("content"), strict=True), "accepted")
        .otherwise("not_xml")
    )
    plain = files.filter(~is_archive).select("path", size.alias("size"), status.alias("status"))
    return plain.unionByName(packed).select("path", size_kb(F.col("size")).alias("size_kb"), "status")


def intake_totals(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
