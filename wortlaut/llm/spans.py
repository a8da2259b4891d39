"""Places of regular expression matches in a text, with built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands around matches while a text is cut up.  Texts must not have it: see ``without_marks``.
_MARK = "\x01"
_BLOCK = 256


def without_marks(text: Column) -> Column:
    """The text with the marking character exchanged for another control character that no pattern names."""
    return F.replace(text, F.lit(_MARK), F.lit("\x02"))


def running_sums(numbers: Column | str) -> Column:
    """The sums of an array of ints up to each entry, block by block, so that long arrays are not copied per entry."""
    numbers = F.col(numbers) if isinstance(numbers, str) else numbers
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
    none = F.array().cast("array<int>")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")),
        lambda b: F.aggregate(
            F.slice(numbers, b * _BLOCK + 1, F.lit(_BLOCK)), none, lambda acc, x: F.concat(acc, F.array(last(acc) + x))
        ),
    )
    carried = F.aggregate(
        blocks,
        F.array().cast("array<array<int>>"),
        lambda acc, b: F.concat(
            acc, F.array(F.transform(b, lambda x: x + F.coalesce(last(F.get(acc, F.size(acc) - 1)), F.lit(0))))
        ),
    )
    return F.flatten(carried)


def with_matches(df: DataFrame, text: str, out: str, pattern: str, guard: Column, around: int = 32) -> DataFrame:
    """Add an array of the leftmost non-overlapping matches: ``start``, ``end`` (code points, end exclusive), ``value``,
    and up to ``around`` characters ``before`` and ``after``.  Texts that fail ``guard`` are known to have none.

    Matches are set between marks and the text is cut at them; every second piece is a match, and the lengths of the
    pieces give the places.
    """
    pieces, ends = f"_{out}_pieces", f"_{out}_ends"
    cut = F.split(F.regexp_replace(F.col(text), F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    found = F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)),
        lambda i: F.struct(
            F.get(ends, i - 1).alias("start"),
            F.get(ends, i).alias("end"),
            F.get(pieces, i).alias("value"),
            F.right(F.get(pieces, i - 1), F.lit(around)).alias("before"),
            F.left(F.get(pieces, i + 1), F.lit(around)).alias("after"),
        ),
    )
    return (
        df.withColumn(pieces, F.when(guard, cut))
        .withColumn(pieces, F.when(F.size(pieces) > 2, F.col(pieces)))
        .withColumn(f"_{out}_lengths", F.transform(pieces, lambda p: F.char_length(p)))
        .withColumn(ends, F.when(F.size(f"_{out}_lengths") > 0, running_sums(f"_{out}_lengths")))
        .withColumn(out, F.when(F.size(pieces) > 2, found).otherwise(none))
        .drop(pieces, ends, f"_{out}_lengths")
    )


def spelled(spans: Column, kind: str) -> Column:
    """Spans as ``kind:start:end`` texts."""
    return F.transform(
        spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
    )
