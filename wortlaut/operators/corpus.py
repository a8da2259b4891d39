"""The tables of a corpus: documents, nodes, text segments, source lines, parse errors."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wortlaut.functions.text import split_lines
from wortlaut.operators.shred import HEAD_COLUMNS, NODE_COLUMNS, shred

DOC_KEYS = ("doc_id", "doc_ord", "subdir", "filename", "quelle")


@dataclass(frozen=True)
class Corpus:
    """A document table and the node table shredded from it.

    ``Corpus.of(docs)`` shreds on every use; ``save`` and ``load`` keep the node table as Parquet, where each check
    reads only its own columns.  ``columns`` limits what an unsaved corpus builds.
    """

    docs: DataFrame
    shredded: DataFrame
    columns: list[str] | None = None  # of an unsaved corpus

    @classmethod
    def of(cls, docs: DataFrame, columns: list[str] | None = None) -> Corpus:
        wanted = list(columns or NODE_COLUMNS)
        return cls(docs, shred(docs, wanted), wanted)

    def document(self, doc_id: str) -> Corpus:
        """The corpus of one document; an unsaved corpus then shreds no other."""
        docs = self.docs.filter(F.col("doc_id") == doc_id)
        if self.columns is not None:
            return Corpus.of(docs, self.columns)
        return Corpus(docs, self.shredded.filter(F.col("doc_id") == doc_id))

    def save(self, path: str) -> None:
        """Write both tables.  Nodes are sorted by tag inside each file, so a check on one tag skips most row groups."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        nodes = self.shredded.sortWithinPartitions("kind", "tag")
        nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/shredded")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Corpus:
        return cls(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/shredded"))

    def save_tables(self, name: str, buckets: int) -> None:
        """Write catalog tables ``name_docs`` and ``name_nodes``, bucketed by document.

        Checks that group by document (uniqueness, statistics) then need no shuffle at all.
        """
        self.docs.write.mode("overwrite").bucketBy(buckets, "doc_id").saveAsTable(f"{name}_docs")
        nodes = self.shredded.repartition(buckets, "doc_id").write.mode("overwrite").partitionBy("kind")
        nodes.bucketBy(buckets, "doc_id").sortBy("tag").saveAsTable(f"{name}_nodes")

    @classmethod
    def load_tables(cls, spark: SparkSession, name: str) -> Corpus:
        return cls(spark.table(f"{name}_docs"), spark.table(f"{name}_nodes"))

    def persist(self) -> Corpus:
        """Keep the node table in executor memory and on disk for several checks in one session."""
        return Corpus(self.docs, self.shredded.persist(StorageLevel.MEMORY_AND_DISK))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.shredded.filter(F.col("kind") == "element")

    @cached_property
    def segments(self) -> DataFrame:
        return text_segments(self.shredded)

    @cached_property
    def parse_errors(self) -> DataFrame:
        return self.shredded.filter(F.col("kind") == "error").select(
            "doc_id", "doc_ord", "subdir", "filename", "line", "column", "error"
        )

    @cached_property
    def lines(self) -> DataFrame:
        return source_lines(self.docs)


#: Columns of the node table that segments are made of; the heads may be missing.
SEGMENT_SOURCE = [*DOC_KEYS, *HEAD_COLUMNS, "kind", "node_id", "parent_id", "child_no", "tag", "parent_tag", "line", "text", "tail"]


def text_segments(shredded: DataFrame) -> DataFrame:
    """Pieces of direct text per element: its own text (seg_no 0), then the tail of each child node.

    ``hint_line`` is the line of the node in front of the piece, where the piece begins or a little earlier.  ``head`` is
    the source from the start of that line to the piece, which follows it as it is; null where that is not known.
    """
    known = set(HEAD_COLUMNS) <= set(shredded.columns)
    text_head, tail_head = (F.col(c) if known else F.lit(None).cast("string") for c in HEAD_COLUMNS)
    own = F.when(
        F.col("kind") == "element",
        F.struct(
            F.col("node_id").alias("owner_id"),
            F.lit(0).alias("seg_no"),
            F.col("tag").alias("tag"),
            F.col("text").alias("text"),
            text_head.alias("head"),
        ),
    )
    tail = F.when(
        F.col("parent_id").isNotNull(),
        F.struct(
            F.col("parent_id").alias("owner_id"),
            (F.col("child_no") + 1).alias("seg_no"),
            F.col("parent_tag").alias("tag"),
            F.col("tail").alias("text"),
            tail_head.alias("head"),
        ),
    )
    present = shredded.select(*DOC_KEYS, F.col("line").alias("hint_line"), F.explode_outer(F.array(own, tail)).alias("s"))
    return present.filter(F.col("s.text") != "").select(
        *DOC_KEYS, "s.owner_id", "s.seg_no", "s.tag", "s.text", "hint_line", "s.head"
    )


def source_lines(docs: DataFrame) -> DataFrame:
    """Numbered source lines, split like str.splitlines()."""
    return docs.select("doc_id", F.posexplode(split_lines(F.col("content").cast("string"))).alias("n", "text")).select(
        "doc_id", (F.col("n") + 1).alias("line_no"), "text"
    )
