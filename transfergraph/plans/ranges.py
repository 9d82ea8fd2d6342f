"""Range joins with an equi-key: time (or block) is cut into buckets as wide as the range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_after(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_at: str, right_at: str, width: int, include_equal: bool = False) -> DataFrame:
    """left x right where the `on` columns are equal and right_at is in (left_at, left_at + width] (from left_at on with include_equal).

    Column names must differ. Each left row goes to its own bucket and the next, so a key's rows are spread over its buckets and
    only neighbours in time meet; Spark joins by hash on (keys, bucket), and splits skewed partitions.
    """
    b = F.floor(F.col(left_at) / width)
    near = left.withColumn("_bucket", F.explode(F.array(b, b + 1)))
    there = right.withColumn("_right_bucket", F.floor(F.col(right_at) / width))
    keys: Column = F.col("_bucket") == F.col("_right_bucket")
    for x, y in on:
        keys = keys & (F.col(x) == F.col(y))
    gap = F.col(right_at) - F.col(left_at)
    low = gap >= 0 if include_equal else gap > 0
    return near.join(there, keys & low & (gap <= width)).drop("_bucket", "_right_bucket")


def as_of(left: DataFrame, right: DataFrame, left_at: str, right_at: str, value: str, width: int, on: list[str] | None = None) -> DataFrame:
    """left with the column `value` of the last row of right at or before its time (null before the first), for equal keys `on` if given.

    Both sides are one table in order of time, cut into blocks `width` long, and within a block the last value seen is a running window; what a
    block begins with is carried in from the last value of the blocks before, of which there is one row each. So a key's rows (or all rows, without
    a key) are spread over its blocks, and only the blocks of one key meet in a task. At equal times right comes first, of several the greatest
    value counts. Times are numbers; null times match nothing.
    """
    keys = on or []
    at = lambda c: F.col(c).cast("long")
    mine = left.select(*keys, at(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.struct(*left.columns).alias("_row"))
    theirs = right.where(F.col(right_at).isNotNull() & F.col(value).isNotNull()).select(*keys, at(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"))
    both = mine.unionByName(theirs).withColumn("_block", F.floor(F.col("_at") / width))
    blocks = both.groupBy(*keys, "_block").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_value"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_block", F.last("_last", ignorenulls=True).over(before)["_value"].alias("_carried"))
    seen = Window.partitionBy(*keys, "_block").orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    found = both.join(carried, [*keys, "_block"], "left").withColumn("_seen", F.last("_value", ignorenulls=True).over(seen))
    return found.where("_side = 1").select("_row.*", F.when(F.col("_at").isNotNull(), F.coalesce("_seen", "_carried")).alias(value))


#: A cell of a grid join is split when either side has more rows in it.
CELL_ROWS = 20_000


def join_cells(left: DataFrame, right: DataFrame, cell: list[str], limit: int = CELL_ROWS) -> DataFrame:
    """left inner join right on the columns `cell`, in which no task compares more than about limit x limit rows of one cell.

    The rows of a cell are counted on both sides (combined before they are shuffled). A cell of more than `limit` is dealt into parts on each side by a
    hash of the whole row, and each part of one side meets each part of the other: a row is sent once for each part of the other side, a pair is compared
    once. Other columns must differ in name; null cells match nothing.
    """
    n = left.groupBy(*cell).agg(F.count("*").alias("_l")).join(right.groupBy(*cell).agg(F.count("*").alias("_r")), cell)
    parts = n.where((F.col("_l") > limit) | (F.col("_r") > limit)).select(*cell, F.ceil(F.col("_l") / limit).alias("_l"), F.ceil(F.col("_r") / limit).alias("_r"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        mine, theirs = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        row = F.xxhash64(*(c for c in side.columns if c not in cell))
        return side.join(parts, cell, "left").withColumn(f"{own}_part", F.pmod(row, mine)).withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0).cast("long"), theirs - 1))).drop("_l", "_r")

    return dealt(left, "_l", "_r").join(dealt(right, "_r", "_l"), [*cell, "_l_part", "_r_part"]).drop("_l_part", "_r_part")
