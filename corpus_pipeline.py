"""The corpus pipeline: good documents, one of each group of exact and near copies, mixed by source, packed.

A stage takes (spark, docs, sf_dir) and returns a table; the next stage reads it from Parquet.  All but the last return
the columns of ``documents``, whatever their names and whichever further ones there are.

Null texts count as empty, a null source is a source of its own, and documents without a key are kept or dropped by their
text alone; equal rows stay once.  Very long texts are worked on whole.  An empty table gives empty tables all the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wortlaut.llm.exact_dedup import drop_copies
from wortlaut.llm.mixing import take_mix
from wortlaut.llm.packing import pack
from wortlaut.llm.quality import keep_good
from wortlaut.llm.queries import vocabulary
from wortlaut.llm.shared import scratch_path
from wortlaut.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest id of each group of equal texts, once."""
    return drop_copies(docs, repeats=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it."""
    return take_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
