"""Well-formedness report and validation totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_wellformed(parse_errors: DataFrame) -> DataFrame:
    """First fatal error of each document that does not parse."""
    return parse_errors.select(F.lit("").alias("quelle"), "subdir", "filename", "line", "column", "error", "doc_id",
                               "doc_ord", F.lit(None).cast("int").alias("node_id"))


def validation_summary(shredded: DataFrame, schema_errors: DataFrame | None = None) -> DataFrame:
    """One row: documents checked, documents with errors of either kind, and the number of errors.

    A document has exactly one root row or one error row, so documents are counted without a distinct.
    """
    parsed = shredded.filter((F.col("kind") == "error") | (F.col("node_id") == 0)).agg(
        F.count(F.lit(1)).alias("files_checked"),
        F.count_if(F.col("kind") == "error").alias("files_with_wellformed_errors"),
        F.count_if(F.col("kind") == "error").alias("wellformed_errors"),
    )
    if schema_errors is None:
        return parsed
    violations = (
        schema_errors.groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.count(F.lit(1)).alias("files_with_schema_errors"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("schema_errors"),
        )
    )
    both = parsed.unionByName(violations, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))
