"""Greedy choices by rounds, with the result of the serial order.

Taking candidates one after the other, the best first, and refusing those that clash with one
already taken, looks serial. But a candidate that ranks before everything it clashes with is
taken in any case, and what clashes with it is refused in any case. A round takes all of
these at once, on all timelines; what is left has fewer clashes, and the rounds end when none is left. On
data without long ladders (each candidate clashing with the next better one only) these are a few.

Ranks are whole numbers, distinct within a timeline, the smallest first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import apart, stored


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rank_no") -> DataFrame:
    """Numbers the rows of each timeline in the given order, from 1 on."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def refused(clashes: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, rank_no) of the candidates that the serial order refuses. ``clashes`` has pairs of ranks in columns a and
    b, in any direction and number; candidates without clash need not occur."""
    edges = clashes.where(F.col(a) != F.col(b)).select(*by, F.least(a, b).alias("better"), F.greatest(a, b).alias("worse")).distinct()
    edges, out = stored(edges, "greedy"), None
    while not edges.isEmpty():
        taken = edges.select(*by, "better").distinct().join(apart(edges.select(*by, F.col("worse").alias("better")).distinct()), [*by, "better"], "left_anti")
        lost = stored(edges.join(apart(taken), [*by, "better"]).select(*by, "worse").distinct(), "greedy")
        out = lost if out is None else out.unionByName(lost)
        edges = edges.join(apart(lost), [*by, "worse"], "left_anti").join(apart(lost.withColumnRenamed("worse", "better")), [*by, "better"], "left_anti")
        edges = stored(edges, "greedy")
    return (edges.select(*by, "worse") if out is None else out).withColumnRenamed("worse", "rank_no")


def matching(pairs: DataFrame, by: list[str], a: str, b: str, rank: str) -> DataFrame:
    """The pairs that the serial order takes when each item may be in one pair: those that rank first
    among all pairs of both their items, then the same among what is left."""
    left, out = stored(pairs.where(F.col(a) != F.col(b)), "matching"), []
    while not left.isEmpty():
        ends = left.select(*by, F.col(a).alias("item"), rank).unionByName(left.select(*by, F.col(b).alias("item"), rank))
        first = ends.groupBy(*by, "item").agg(F.min(rank).alias("first"))
        both = left
        for side in (a, b):
            both = both.join(first.select(*by, F.col("item").alias(side), F.col("first").alias(f"first_{side}")), [*by, side])
        taken = stored(both.where((F.col(rank) == F.col(f"first_{a}")) & (F.col(rank) == F.col(f"first_{b}"))).select(*left.columns), "matching")
        out.append(taken)
        gone = taken.select(*by, F.col(a).alias("item")).unionByName(taken.select(*by, F.col(b).alias("item")))
        for side in (a, b):
            left = left.join(gone.withColumnRenamed("item", side), [*by, side], "left_anti")
        left = stored(left.select(*pairs.columns), "matching")
    found = left
    for taken in out:
        found = found.unionByName(taken)
    return found
