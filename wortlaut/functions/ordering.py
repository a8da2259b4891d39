"""Order keys and positions that never need all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def document_position(df: DataFrame, minor: Column | None = None) -> Column:
    """One value that orders nodes by document, then by place in the document (then by ``minor`` < 65536).

    With an integral ``doc_ord`` the key is a packed decimal, a fixed-width type, so ``min`` over it stays a hash
    aggregate; otherwise it is a struct.
    """
    if isinstance(df.schema["doc_ord"].dataType, _INTEGRAL):
        key = F.col("doc_ord").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("node_id")
        if minor is not None:
            key = key * F.lit(65536).cast("decimal(5,0)") + minor
        return key.cast("decimal(38,0)")
    parts = [F.col("doc_ord"), F.col("node_id")]
    return F.struct(*parts, *([minor.alias("minor")] if minor is not None else []))


#: Bits of the order value that one level tells apart, and the levels above single rows.
_DIGIT, _LEVELS = 16, (16, 32, 48)


def running_total(
    df: DataFrame, ord_col: str, value: Column, out: str, group: tuple[str, ...] = (), total: str | None = None
) -> DataFrame:
    """Add the sum of ``value`` over the rows before each row, in the order of the integral column ``ord_col``, which
    is unique within ``group``; and, as ``total``, the sum over the group.

    A window over a whole group would sort it in one task.  Here the order value is read digit by digit, 16 bits each:
    rows with the same upper digits are summed level by level, one small row each, and a row's place is the sum of what
    comes before it on every level.  So no window holds more than 65,536 rows, however the order values lie.
    """
    unsigned = F.col(ord_col).cast("long").bitwiseXOR(F.lit(-(2**63)))
    rows = df.withColumn("_value", value).withColumn("_d16", F.shiftrightunsigned(unsigned, _DIGIT))
    sums = {16: rows.groupBy(*group, "_d16").agg(F.sum("_value").alias("_sum"))}
    for below, level in zip(_LEVELS, _LEVELS[1:]):
        digit = F.shiftrightunsigned(F.col(f"_d{below}"), _DIGIT).alias(f"_d{level}")
        sums[level] = sums[below].groupBy(*group, digit).agg(F.sum("_sum").alias("_sum"))

    def before(summed: str, within: list, order: str) -> Column:
        earlier = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(summed).over(earlier), F.lit(0))

    top = [*group, F.col("_d48") * 0]
    whole = Window.partitionBy(*top)
    placed = sums[48].select(
        *group, "_d48", before("_sum", top, "_d48").alias("_before"), F.sum("_sum").over(whole).alias("_total")
    )
    for level, above in ((32, 48), (16, 32)):
        own = sums[level].withColumn(f"_d{above}", F.shiftrightunsigned(F.col(f"_d{level}"), _DIGIT))
        own = own.withColumn("_own", before("_sum", [*group, f"_d{above}"], f"_d{level}"))
        placed = own.join(placed, [*group, f"_d{above}"]).select(
            *group, f"_d{level}", (F.col("_before") + F.col("_own")).alias("_before"), "_total"
        )
    inside = before("_value", [*group, "_d16"], ord_col)
    done = rows.withColumn("_own", inside).join(placed, [*group, "_d16"]).withColumn(out, F.col("_before") + F.col("_own"))
    if total:
        done = done.withColumn(total, F.col("_total"))
    return done.select(*df.columns, out, *([total] if total else []))


def with_position(df: DataFrame, ord_col: str, out: str = "position", group: tuple[str, ...] = ()) -> DataFrame:
    """Number the rows of each group 0, 1, 2, … in the order of ``ord_col``."""
    return running_total(df, ord_col, F.lit(1).cast("long"), out, group)
