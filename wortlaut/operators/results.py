"""Shape of check results: the columns of the check, then the position of the hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE = ("quelle", "subdir", "filename")
POSITION = ("doc_id", "doc_ord", "node_id")


def result(df: DataFrame, *columns: str | Column, node_id: str = "node_id") -> DataFrame:
    return df.select(*SOURCE, *columns, "doc_id", "doc_ord", F.col(node_id).alias("node_id"))


def present(results: DataFrame, *minor: str) -> DataFrame:
    """Rows in corpus order without the position columns, as a report shows them."""
    return results.orderBy("doc_ord", "node_id", *minor).drop(*POSITION, *minor)
