"""Exact copies: local combining, salted merging of digest groups, and a global combine of the salt winners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wortlaut.llm.shared import SALTS, ascii_lower, checkpointed, give_back, keep_decided, salt_mask, salt_of, text_of


def mark_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS, digest_bytes: int = 32
) -> DataFrame:
    """One row per document: ``key``, ``keep_id`` (largest key of the equal texts), ``group_size``, ``kept``,
    ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  The content itself is part of every
    grouping key, so all three steps compare whole texts, never digests alone:

    1. each task combines its own equal rows (the partial aggregate before the shuffle);
    2. rows of one digest meet salt by salt, a hot group in ``salts`` tasks;
    3. the salt winners, at most ``salts`` rows per text, are combined by digest.

    A digest that step 3 saw with one content only stands for that content, so rows get their group back over the
    digest, without the text; digests with several contents are matched by the content as well.

    Rows with a null key take part but never win against one with a key (``kept`` is false for them, unless every
    key of the group is null: then all are kept and ``keep_id`` is null).  Rows that repeat both key and text share
    one decision.  An empty table gives an empty result; extra columns are ignored.
    """
    content = ascii_lower(text_of(text))
    rows = (
        docs.select(F.col(key).alias("doc_id"), content.alias("content"))
        .withColumn("sha", F.unhex(F.sha2(F.col("content"), 256)))
        .withColumn("digest", F.substring("sha", 1, digest_bytes))
        .withColumn("salt", salt_of("doc_id", salts))
    )
    merged = rows.groupBy("digest", "salt", "content").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    groups = (
        merged.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), salt_mask().alias("mask"))
    )
    winners = checkpointed(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("contents"),
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
            F.bit_or("mask").alias("mask"),
        )
    )
    slim = rows.select("doc_id", "sha", "digest", "salt")
    single = winners.filter("contents = 1").drop("contents")
    marked = give_back(slim, single, "digest", salts)
    clashes = winners.filter("contents > 1").select("digest")
    if not clashes.isEmpty():
        among = rows.join(clashes, "digest").withColumn("group", F.struct("digest", "content")).drop("digest", "content")
        full = groups.join(clashes, "digest").withColumn("group", F.struct("digest", "content")).drop("digest", "content")
        marked = marked.drop("digest").unionByName(give_back(among, full, "group", salts).drop("group"))
    return marked.select(
        F.col("doc_id").alias(key),
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", repeats: bool = True) -> DataFrame:
    """The documents that stay, with all their columns.  Documents without a key are never dropped.

    A row is dropped for its own key and text: where a key is not unique, its other texts are decided on their own.
    Rows that repeat both key and text of one that stays, stay too; ``repeats=False`` leaves any one of them.
    """
    digest = F.unhex("text_sha256")
    decided = mark_copies(docs, key, text).select(
        F.col(key).alias("_key"), digest.alias("_digest"), digest.alias("_group"), F.col("kept").alias("_kept")
    )
    return keep_decided(docs, decided, key, F.unhex(F.sha2(ascii_lower(text_of(text)), 256)), repeats)
