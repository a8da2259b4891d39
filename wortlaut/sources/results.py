"""Writing results, and showing the source around a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wortlaut.functions.bloom import bloom_filter, may_contain
from wortlaut.functions.sizes import staged
from wortlaut.operators.results import POSITION


def write_results(results: DataFrame, path: str) -> bool:
    """Write a report as ';'-separated CSV with a heading; nothing is left of an empty one.  The check runs once."""
    kept = results.drop(*(c for c in POSITION if c in results.columns))
    seen = Observation()
    counted = kept.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)
    if seen.get["rows"]:
        return True
    spark = results.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return False


def preview_lines(content: Column) -> Column:
    """The lines of a document, cut at line feeds alone."""
    text = F.replace(content.cast("string"), F.lit("\r\n"), F.lit("\n"))
    return F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n")


def with_source_lines(results: DataFrame, docs: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """(doc_id, line, line_no, text, is_hit) for each distinct hit line of the results.

    The hit lines of a document are collected and meet the document once; only the lines shown are made rows.  They are
    staged in the shared folder, and of the documents only those go on that may hold one, by a Bloom filter: where the
    lines are many enough for a shuffle, contents without a hit are not part of it.
    """
    asked = results.select("doc_id", "line").dropna().groupBy("doc_id").agg(F.collect_set("line").alias("_asked"))
    asked = staged(asked)
    held = docs.select("doc_id", "content").filter(may_contain(bloom_filter(asked, "doc_id"), F.col("doc_id")))
    cut = held.join(asked, "doc_id").withColumn("_lines", preview_lines(F.col("content")))

    def shown(line: Column) -> Column:
        first = F.greatest(F.lit(1), line - before)
        last = F.least(F.size("_lines"), line + after)
        numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            numbers, lambda n: F.struct(line.alias("line"), n.alias("line_no"), F.get("_lines", n - 1).alias("text"))
        )

    rows = cut.select("doc_id", F.explode(F.flatten(F.transform("_asked", shown))).alias("r")).select("doc_id", "r.*")
    return rows.withColumn("is_hit", F.col("line_no") == F.col("line"))
