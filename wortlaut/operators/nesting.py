"""Self-nesting of a tag, and text length statistics per document."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wortlaut.functions.text import round_one_decimal
from wortlaut.operators.results import SOURCE, result


def nesting(nodes: DataFrame, tag: str, direct: bool = True) -> DataFrame:
    """Elements nested in elements of the same tag.

    ``direct``: only the unbroken run of same-tag ancestors right above counts.  Otherwise every same-tag ancestor
    counts, and the details show the path from the outermost one.  The path column holds all that is needed.
    """
    tag = tag.strip()
    name = re.sub(r"([^\w])", r"\\\1", tag)
    matched = nodes.filter(F.col("tag") == tag)
    if direct:
        run = F.regexp_extract(F.concat(F.lit("/"), F.col("path")), f"((?:/{name})+)$", 1)
        depth = F.floor(F.length(run) / F.lit(len(tag) + 1))
        shown = F.substring(run, 2, 1 << 30)
    else:
        depth = F.size(F.filter(F.split("path", "/"), lambda step: step == tag))
        shown = F.regexp_extract("path", f"(?:^|/)({name}(?:/.*)?)$", 1)
    rows = matched.withColumn("depth", depth.cast("int")).filter(F.col("depth") > 1)
    return result(rows, "line", "depth", F.replace(shown, F.lit("/"), F.lit(" > ")).alias("details"))


def tag_stats(nodes: DataFrame, tag: str) -> DataFrame:
    """Per document: number of elements of a tag, and least, greatest and mean text length.

    Every parsed document has its root among the nodes, so documents without the tag stay in the result (count 0,
    NULL lengths) without a join.
    """
    length = F.when(F.col("tag") == tag.strip(), F.col("string_len"))
    stats = nodes.groupBy("doc_id", "doc_ord", *SOURCE).agg(
        F.count(length).alias("count"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.sum(length).alias("_sum"),
    )
    mean = F.when(F.col("count") > 0, F.col("_sum") / F.col("count"))
    return stats.withColumn("node_id", F.lit(0)).select(
        *SOURCE, "count", "min_length", "max_length", round_one_decimal(mean).alias("avg_length"),
        "doc_id", "doc_ord", "node_id",
    )
