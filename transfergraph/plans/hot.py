"""Joins whose large side may have keys with a great share of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import materialise

#: A key with over one part in so many of the rows is hot; with more shuffle partitions than this, their number takes its place.
PARTS = 1000


def hot_parts(df: DataFrame) -> int:
    """One part in so many of the rows makes a key hot: no key that is shuffled fills more than about one partition, and there are fewer hot keys than this."""
    return max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def join_counted(big: DataFrame, keyed: DataFrame, on: list[str], n: str, parts: int | None = None, rows: int | None = None, write: bool = True) -> DataFrame:
    """big inner join keyed on the columns `on`; keyed has one row per key, with the number of big's rows that have it in column n.

    Rows of hot keys (over one part in `parts` of all rows, so fewer than `parts` keys) stay where they are and meet a broadcast of
    those keys; the others are shuffled, and none of them fills a task. big is read twice, so it should be a written table; rows is
    its number of rows, counted if not given; keyed is written first unless that is switched off, and is then planned twice.
    Null keys match nothing. Columns: `on`, then the rest of big, then the rest of keyed without n.
    """
    parts = parts or hot_parts(big)
    rows = big.count() if rows is None else rows
    keyed = materialise(keyed) if write else keyed
    is_hot = F.col(n) * parts > rows
    hot = F.broadcast(keyed.where(is_hot))  # fewer than parts rows: their counts add up to rows at most
    columns = [*on, *(c for c in big.columns if c not in on), *(c for c in keyed.columns if c not in on and c != n)]
    there = big.join(hot, on).select(*columns)
    rest = big.join(hot.select(*on), on, "left_anti").join(keyed.where(~is_hot), on).select(*columns)
    return there.unionByName(rest)
