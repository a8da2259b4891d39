"""A Bloom filter over the values of a column, asked inside rows before anything is moved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 256 KB, whatever the number of values.  Up to some 300,000 values, fewer than one in a hundred others pass;
#: with more values more do, which the join behind the filter sorts out.
BITS = 1 << 21
_HASHES = 5


def _places(value: Column, bits: int) -> list[Column]:
    """The bits of a value, by double hashing."""
    first, second = F.xxhash64(value).bitwiseAND(F.lit((1 << 40) - 1)), F.hash(value).cast("long") * 2 + 1
    return [F.pmod(first + second * i, F.lit(bits)) for i in range(_HASHES)]


def bloom_filter(values: DataFrame, column: str, bits: int = BITS) -> Column:
    """The filter of all values as an expression: a scalar subquery, which Spark works out once and hands to every task.

    Values need not be distinct, and nothing leaves a task but its words of the filter, ``bits`` / 64 at most.  A null is
    not a value.
    """
    if bits % 64:
        raise ValueError("a filter has whole words of 64 bits")
    given = values.filter(F.col(column).isNotNull()).select(F.explode(F.array(*_places(F.col(column), bits))).alias("place"))
    word, bit = F.expr("cast(place div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bits")
    empty = values.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = given.select(word, bit).unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return words.agg(F.transform(in_order, lambda w: w["bits"])).scalar()


def may_contain(words: Column, value: Column, bits: int = BITS) -> Column:
    """False only for values that are not in the filter (and for null)."""
    bit = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in _places(value, bits)]
    return F.coalesce(reduce(lambda a, b: a & b, bit) & value.isNotNull(), F.lit(False))
