"""Running sums over a long index, in levels of blocks: no window ever holds more than one block.

The sums of blocks of BLOCK index values are rows of the next level, with the block's number as their index, up to a
level of one block. On the way down each block's start is added to what is before a row within the block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def levels_for(last: int | None, block: int = BLOCK) -> int:
    """Levels above the rows that an index up to ``last`` needs."""
    count = 0
    while last is not None and last >= block:
        last //= block
        count += 1
    return count


def running_sums(rows: DataFrame, index: str, value: str, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds ``first``: the sum of ``value`` over all rows of the same ``keys`` with a smaller ``index`` (a long from 0 on, each
    at most once for the keys)."""
    keys = keys or []
    levels = levels_for(rows.agg(F.max(index)).first()[0], block)
    sums = [rows.select(*keys, F.col(index).cast("long").alias("i"), F.col(value).cast("long").alias("s"))]
    for _ in range(levels):
        sums.append(sums[-1].groupBy(*keys, F.floor(F.col("i") / F.lit(block)).alias("i")).agg(F.sum("s").alias("s")))
    starts = None
    for level in reversed(sums[1:]):
        starts = within(level.withColumn("block", F.floor(F.col("i") / F.lit(block))), keys, "i", "s", starts)
        starts = starts.select(*keys, F.col("i").alias("block"), F.col("first").alias("start"))
    # the rows take their blocks' starts along with their own columns, and are not met again
    return within(rows.withColumn("block", F.floor(F.col(index) / F.lit(block))), keys, index, value, starts).select(*rows.columns, "first")


def within(rows: DataFrame, keys: list[str], index: str, value: str, starts: DataFrame | None) -> DataFrame:
    """Adds ``first`` to rows with their ``block``: the sum of what is before within the block, and before it."""
    before = Window.partitionBy(*keys, "block").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("first", F.coalesce(F.sum(F.col(value).cast("long")).over(before), F.lit(0)))
    return own if starts is None else own.join(starts, [*keys, "block"]).withColumn("first", F.col("first") + F.col("start"))
