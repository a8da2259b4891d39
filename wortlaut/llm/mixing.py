"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wortlaut.llm.shared import WORD, checkpointed, repeat_rows, text_of

#: Documents of one source and size are placed in so many parts, so that no window holds a whole hot group.
PARTS = 64


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def _offset(source: str) -> Column:
    """The random offset of a source in [0, 1): the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(source), F.lit("\n")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Words each source gives to the mix: ``source``, ``source_size``, ``target``.

    ``sizes`` has one row per source (``source``, ``source_size``).  Sources in code point order, null last, take the
    weights in turn and share the sum of all sizes; a target stops at ``most`` times its source's size and the excess
    is shared again by weight until none is above.  That is one level L with target = min(most * size, L * weight):
    over sources ordered by the L at which they stop, L is the largest of (total - stopped before) / weights left.
    The table has one line per source.
    """
    every = Window.partitionBy()
    turn = (F.row_number().over(every.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    stops = F.col("stop") / F.col("weight")
    by_stop = every.orderBy(stops, F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("stop").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    return (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("long"))
        .withColumn("stop", F.col("source_size") * most)
        .withColumn("level", (F.sum("source_size").over(every) - before) / left)
        .withColumn("level", F.max("level").over(every))
        .select(
            "source",
            "source_size",
            F.least(F.col("stop").cast("double"), F.col("level") * F.col("weight")).alias("target"),
        )
    )


def draw_mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    parts: int = PARTS,
    mark: Column | None = None,
) -> DataFrame:
    """One row per document: ``key``, ``source``, ``size`` (words), ``source_size``, ``target``, ``copies``, ``taken``.

    A document's expected copies are its source's target over its source's size.  Documents of a source stand in
    order of size, then key; their expected copies are summed up from the start, one random offset per source is
    added, and a document is taken once for every whole number that the sum crosses at it.  So sizes are drawn evenly,
    the words taken come within about one large document of the target, and nobody is taken more than ``most`` times.

    A place in the order is found without sorting a source in one task: sizes of a source are counted (one line per
    size), then ``parts`` parts of each size, and only the rows of one part are numbered together.

    The offset and the order depend on the rows alone, so reruns agree.  Null texts have size 0; a null source is a
    source of its own; a null key comes first; repeated rows count one by one.  With no words at all targets are 0.
    An empty table gives an empty table; other columns are ignored.  ``mark`` is a short expression over the documents
    that comes along as the column ``mark``.
    """
    marked = [] if mark is None else [mark.alias("mark")]
    part = F.coalesce(F.expr("conv(substring(md5(cast(doc_id as string)), 1, 4), 16, 10)").cast("int") % parts, F.lit(0))
    rows = checkpointed(
        docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), *marked)
        .withColumn("part", part)
    )
    counted = rows.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    by_size = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes, weights, most)

    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts_before = counted.withColumn("left_of", earlier(Window.partitionBy("source", "size").orderBy("part")))
    sizes_before = by_size.select(
        F.col("source").alias("_source"), F.col("size").alias("_size"),
        earlier(Window.partitionBy("source").orderBy("size")).alias("lower"),
    )
    aims = targets.withColumnRenamed("source", "_aim")
    places = (
        parts_before.join(sizes_before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
        .join(aims, F.col("source").eqNullSafe(F.col("_aim")))
        .select(
            F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("part").alias("_part"),
            (F.col("lower") + F.col("left_of")).alias("start"), "source_size", "target",
        )
    )
    numbered = rows.withColumn(
        "number", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("doc_id"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("rate") * F.col("place") + F.col("u")) - F.floor(F.col("rate") * (F.col("place") - 1) + F.col("u"))
    return (
        numbered.join(
            places,
            F.col("source").eqNullSafe(F.col("_source"))
            & (F.col("size") == F.col("_size"))
            & (F.col("part") == F.col("_part")),
        )
        .withColumn("place", F.col("start") + F.col("number"))
        .withColumn("rate", rate)
        .withColumn("u", _offset("source"))
        .withColumn("copies", crossed.cast("long"))
        .select(
            F.col("doc_id").alias(key), "source", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"), *(["mark"] if marked else []),
        )
    )


def take_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is drawn, with all their columns.

    A row is told by its key, source and whole text, nulls included, so rows without a key are drawn like others.  Rows
    that are equal in all three are interchangeable: one of them comes as often as they are drawn together.  An empty
    table gives an empty table; columns may have any names.
    """
    none = F.lit("\x00")  # before a text, which cannot be confused with a null
    own = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), none) for c in (key, source)]
    row = F.sha2(F.concat_ws("\x01", *own, text_of(text)), 256)
    drawn = draw_mix(docs, key, text, source, mark=row).groupBy(F.col("mark").alias("_row"))
    drawn = checkpointed(drawn.agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).filter("_copies > 0"))
    rows = docs.select(F.struct("*").alias("_doc"), row.alias("_row"))
    taken = rows.join(drawn.filter("_rows = 1"), "_row")
    twins = drawn.filter("_rows > 1")
    if not twins.isEmpty():
        taken = taken.unionByName(rows.join(twins, "_row").dropDuplicates(["_row"]))
    return repeat_rows(taken, "_copies").select("_doc.*")
