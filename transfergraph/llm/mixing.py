"""Operator 1, mixing sources to target weights: whole passes, then a subset-sum fit of what is left of each budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.cut import materialise
from ..plans.hot import join_counted
from .common import WORD, table

#: The last so many words of a source's budget are fitted by dynamic programming; the rest is filled in proportion to each length's count.
WINDOW = 65536
#: Documents of one source and length are ranked within so many ranges of a seeded hash; only the range that holds the cut is sorted.
RANGES = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """(source, source_size, target): one row per source, from (source, source_size).

    Sources in code point order, null last, take the weights in turn and share the total; a target stops at max_repeat times its
    source's size and the excess is shared by weight among the others until none is above. That fixed point is
    min(max_repeat * size, level * weight): the sources below the level are a prefix in the order of size / weight.
    One row per source reaches the window functions.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    w = sizes.select("source", "source_size", total.cast("double").alias("total"), weight.cast("double").alias("w")).withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    before = Window.partitionBy().orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    spent, taken = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (F.col("total") - spent) / (F.sum("w").over(Window.partitionBy()) - taken)
    lowest = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level"))))
    w = w.withColumn("level", level).withColumn("at", lowest.over(Window.partitionBy())["level"])
    return w.select("source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("w"), F.col("cap"))).alias("target"))


def fit(size: np.ndarray, count: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each size to take so that their sizes sum to budget, or as near below it as the sizes allow.

    Each size first gets its share, budget * count / sum of sizes, rounded down. Then sizes are taken once more from the largest down
    while over `window` words are missing, and a bounded knapsack over the documents left fits the rest exactly.
    """
    size, count = [int(x) for x in size], [int(x) for x in count]
    whole = sum(s * n for s, n in zip(size, count, strict=True))
    if budget >= whole:
        return np.array(count, np.int64)
    take = [n * budget // whole for n in count]
    left = budget - sum(s * k for s, k in zip(size, take, strict=True))
    order = sorted((k for k in range(len(size)) if size[k]), key=lambda k: -size[k])
    for k in order:
        if left <= window:
            break
        more = min(count[k] - take[k], left // size[k], -((window - left) // size[k]), 1)
        take[k] += more
        left -= more * size[k]
    for k in order:
        if left <= window:
            break
        more = min(count[k] - take[k], left // size[k], -((window - left) // size[k]))
        take[k] += more
        left -= more * size[k]
    for k, more in knapsack([(k, size[k], count[k] - take[k]) for k in order], left):
        take[k] += more
    return np.array(take, np.int64)


def knapsack(items: list[tuple[int, int, int]], budget: int) -> list[tuple[int, int]]:
    """(item, copies) whose sizes sum to the largest reachable sum up to budget. items: (item, size, copies there are), copies in powers of two."""
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by, step = np.full(budget + 1, -1, np.int32), []
    for k, size, copies in items:
        copies, part = min(copies, budget // size), 1
        while copies > 0 and not reached[budget]:
            part = min(part, copies)
            new = np.flatnonzero(reached[: budget + 1 - part * size])
            new = new[~reached[new + part * size]] + part * size
            reached[new] = True
            by[new] = len(step)
            step.append((k, part, part * size))
            copies, part = copies - part, part * 2
        if reached[budget]:
            break
    at, out = int(np.flatnonzero(reached)[-1]), []
    while at:
        k, part, words = step[by[at]]
        out.append((k, part))
        at -= words
    return out


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    left = int(round(float(pdf["rest"].iloc[0])))
    return pdf[["key", "size", "n"]].assign(take=fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), left))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) of every row.

    A document of a source with target T and size S is taken floor(T / S) times, and once more if the fit of the remaining
    T mod S selects it: the fit says how many documents of each exact length, a seeded hash of doc_id says which. Rows that are alike
    in doc_id, source and length are ranked in any order, which doesn't change the result. Null or blank texts have size 0 and are
    never taken beyond 0 words; a null source is a source; an empty table gives no rows. Of a long text only its number of words is
    kept; columns beyond doc_id, text and source are not read.
    What is shuffled is four numbers a document and a histogram of lengths; a task holds the distinct lengths of one source, which
    grow with the square root of its words at most.
    """
    sized = materialise(
        docs.select(
            "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"),
            F.xxhash64(F.lit(seed), "doc_id").alias("h"),
        )
    )
    sized = sized.withColumn("range", F.shiftright("h", 54))
    lengths = materialise(sized.groupBy("key", "source", "size").agg(F.count("*").alias("n")))
    share = materialise(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, max_repeat))
    share = share.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("passes"))
    rest = lengths.join(share, "key").select("key", "size", "n", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"))
    chosen = materialise(rest.groupBy("key").applyInPandas(_fit_source, "key string, size long, n long, take long"))
    part = chosen.where("take > 0 and take < n")
    within = Window.partitionBy("key", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sized.groupBy("key", "size", "range").agg(F.count("*").alias("c")).join(part.select("key", "size", "take"), ["key", "size"])
    cut = ranges.withColumn("before", F.coalesce(F.sum("c").over(within), F.lit(0))).where("before < take and take <= before + c").select("key", "size", F.col("range").alias("cut"), (F.col("take") - F.col("before")).alias("need"))
    decided = join_counted(sized, chosen.join(cut, ["key", "size"], "left").withColumn("rows", F.col("n")), ["key", "size"], "rows")
    split = F.col("range") == F.coalesce("cut", F.lit(-9999))
    clear = decided.where(~split).select("doc_id", "key", "source", "size", F.when(F.col("take") == F.col("n"), 1).when(F.col("range") < F.col("cut"), 1).otherwise(0).alias("extra"))
    ranked = decided.where(split).withColumn("rank", F.row_number().over(Window.partitionBy("key", "size", "range").orderBy("h", "doc_id")))
    every = clear.unionByName(ranked.select("doc_id", "key", "source", "size", F.when(F.col("rank") <= F.col("need"), 1).otherwise(0).alias("extra")))
    return every.join(share, "key").select("doc_id", "size", "source", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("extra"))).alias("taken"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What mix() takes of each row, with its source; nulls, empty texts, repeated rows, empty tables and other columns are as there."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")
