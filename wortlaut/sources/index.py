"""Directory index of a file listing, search in it, and selection of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wortlaut.functions.paths import parent, prefixes, strict_ancestors
from wortlaut.sources.documents import size_kb


def directory_index(files: DataFrame) -> DataFrame:
    """Directories and files of a listing ``(path, length)`` with '/'-separated relative paths.

    A directory counts the .xml files in its whole subtree; hidden files and files at the root are left out of the
    file rows.  The count is an aggregate with map-side combine, so the top directories are no hot keys.
    """
    name = F.element_at(F.split("path", "/"), -1)
    shown = files.withColumn("name", name).withColumn("_hidden", F.col("name").startswith("."))
    is_xml = F.lower("name").endswith(".xml") & ~F.col("_hidden")
    directories = (
        shown.select(F.explode(strict_ancestors(F.col("path"))).alias("dir"), is_xml.alias("is_xml"))
        .groupBy("dir")
        .agg(F.count_if("is_xml").alias("file_count"))
        .withColumnRenamed("dir", "path")
    )
    depth = F.size(F.split("path", "/")) - 1
    dir_rows = directories.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(True).alias("is_dir"),
        depth.alias("depth"), "file_count", F.lit(None).cast("double").alias("size_kb"),
    )
    file_rows = shown.filter(~F.col("_hidden") & F.contains("path", F.lit("/"))).select(
        "path", "name", F.lit(False).alias("is_dir"), depth.alias("depth"),
        F.lit(None).cast("long").alias("file_count"), size_kb(F.col("length")).alias("size_kb"),
    )
    return dir_rows.unionByName(file_rows)


def index_order() -> Column:
    """Depth-first, siblings by lower-cased name."""
    return F.transform(F.split("path", "/"), F.lower)


def search_index(index: DataFrame, needle: str) -> DataFrame:
    """Rows whose name contains the needle in any case, and all directories above them."""
    hits = index.filter(F.contains(F.lower("name"), F.lit(needle.lower())))
    above = hits.select(F.explode(prefixes(F.col("path"))).alias("path"))
    return index.join(above.distinct(), "path", "left_semi")


def _covered(index: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """Rows that are (``left_semi``) or are not (``left_anti``) chosen or below a chosen directory.

    Every path meets the chosen ones over itself and the directories above it; a null path chooses nothing.
    """
    wanted = chosen.select(F.col("path").alias("up")).dropna().distinct()
    inside = index.select("path", F.explode(prefixes(F.col("path"))).alias("up")).join(wanted, "up", "left_semi")
    return index.join(inside.select("path").distinct(), "path", how)


def select_paths(index: DataFrame, include: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Index rows selected by a table of paths; a directory stands for its subtree; ``exclude`` takes rows out."""
    selected = _covered(index, include, "left_semi")
    return selected if exclude is None else _covered(selected, exclude, "left_anti")


def select_filtered(visible: DataFrame) -> DataFrame:
    """Only the files among the rows a search left visible."""
    return visible.filter(~F.col("is_dir"))


def selected_docs(selection: DataFrame) -> DataFrame:
    """The XML files of a selection: subdir, filename, size_kb."""
    subdir = parent(F.col("path"))
    return selection.filter(~F.col("is_dir") & F.lower("path").endswith(".xml")).select(
        "path", F.when(subdir == "", ".").otherwise(subdir).alias("subdir"), F.col("name").alias("filename"), "size_kb"
    )


def write_index(index: DataFrame, path: str) -> None:
    """The index as JSON lines, one folder per directory of the corpus: its own row and those of its files."""
    directory = F.when(F.col("is_dir"), F.col("path")).otherwise(parent(F.col("path")))
    # a directory's rows go to one task per salt, so the files of a large one are written by several
    dealt = index.withColumn("directory", directory).repartition("directory", F.pmod(F.xxhash64("path"), F.lit(16)))
    dealt.write.mode("overwrite").partitionBy("directory").json(path)


def read_index(spark: SparkSession, path: str, directory: str | None = None, below: bool = True) -> DataFrame:
    """A written index; with ``directory`` only its own row and what is in it, read from its folder alone, and with
    ``below`` also what is in the directories under it, from theirs."""
    schema = "path string, name string, is_dir boolean, depth int, file_count long, size_kb double, directory string"
    rows = spark.read.schema(schema).json(path)
    if directory is not None:
        inside = F.col("directory") == directory
        rows = rows.filter(inside | F.startswith("directory", F.lit(f"{directory}/")) if below else inside)
    return rows.drop("directory")
