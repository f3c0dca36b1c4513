"""Scans along timelines of any length, and choices that depend on the choice before.

A window over a whole timeline sorts it in one task. ``running`` deals the timeline into slices
instead: windows inside the slices, one row of totals a slice, a window over these few, and the
sum of both; a timeline with a third of all rows is then as many tasks as it has slices.

Greedy choices along a timeline (where a chunk ends says where the next begins) become a table
with one row for each place that could be a start, and the place where the next one would begin.
``follow`` finds the places that are really used by composing such steps: after k rounds it has
followed 4**k - 1 of them, on all timelines at once and without one task for a timeline.

``by`` columns that are null belong to no timeline; rows with one get no value from other slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import apart, stored


def _slice(t: str, width) -> Column:
    return F.floor(F.col(t) / F.lit(width))


def running(df: DataFrame, by: list[str], order: list[str], columns: dict[str, tuple[str, Column]], width=None, before: bool = False) -> DataFrame:
    """Adds running values in the order of ``order`` (ascending; ties in any order), up to the row or, with
    ``before``, up to the row before. ``columns`` maps a name to a kind (sum, count, max or last: the last that
    is not null) and an expression. ``width``: width of the slices in units of the first order column.

    Nulls of an expression count as nothing; sums and counts of nothing are 0, others null. Rows whose
    first order column is null come first."""
    kinds = {"sum": F.sum, "count": F.count, "max": F.max}
    df = df.withColumns({f"__x_{n}": x for n, (_, x) in columns.items()})

    def over(name: str, kind: str, w) -> Column:
        x = F.last(f"__x_{name}", ignorenulls=True) if kind == "last" else kinds[kind](f"__x_{name}")
        return x.over(w)

    frame = (Window.unboundedPreceding, -1 if before else 0)
    keys = [*by, "__slice"]
    sliced = df.withColumn("__slice", F.lit(0).cast("long") if width is None else F.coalesce(_slice(order[0], width), F.lit(-(2**62))))
    out = sliced.withColumns({n: over(n, k, Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)) for n, (k, _) in columns.items()})
    if width is not None:
        newest = lambda n: F.max(F.when(F.col(f"__x_{n}").isNotNull(), F.struct(*order, F.struct(f"__x_{n}").alias("x"))))["x"][f"__x_{n}"]
        totals = sliced.groupBy(*keys).agg(*((newest(n) if k == "last" else kinds[k](f"__x_{n}")).alias(f"__t_{n}") for n, (k, _) in columns.items()))
        carry = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        up = {"sum": F.sum, "count": F.sum, "max": F.max}
        totals = totals.select(*keys, *((F.last(f"__t_{n}", ignorenulls=True) if k == "last" else up[k](f"__t_{n}")).over(carry).alias(f"__c_{n}") for n, (k, _) in columns.items()))
        out = out.join(apart(totals), keys, "left")  # the rows lie by these keys already
        join = {"last": lambda a, b: F.coalesce(a, b), "max": lambda a, b: F.greatest(a, b)}
        add = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        out = out.withColumns({n: join.get(k, add)(F.col(n), F.col(f"__c_{n}")) for n, (k, _) in columns.items()}).drop(*(f"__c_{n}" for n in columns))
    zero = [n for n, (k, _) in columns.items() if k in ("sum", "count")]
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in zero}).drop("__slice", *(f"__x_{n}" for n in columns))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, width=None) -> DataFrame:
    """Numbers the rows of each timeline from 0 on; ``order`` should leave no ties."""
    out = running(df, by, order, {name: ("count", F.lit(1))}, width)
    return out.withColumn(name, (F.col(name) - 1).cast("long"))


def follow(steps: DataFrame, starts: DataFrame, by: list[str], at: str = "at", to: str = "to") -> DataFrame:
    """(by, at) of all places reached from ``starts`` (by, at) by the steps (by, at, to), starts included.

    Each place has one step at most, and a step leads forward: to > at. A null end, or a place
    without a step, ends the chain; repeated steps of a place must not be given."""
    jump = stored(steps.where(F.col(to) > F.col(at)).select(*by, F.col(at).alias("__a"), F.col(to).alias("__b")), "jump")
    found = stored(starts.select(*by, F.col(at).alias("__a")).distinct(), "follow")

    def moved(places: DataFrame, by_jump: DataFrame) -> DataFrame:
        return places.join(apart(by_jump), [*by, "__a"]).select(*by, F.col("__b").alias("__a"))

    def twice(by_jump: DataFrame) -> DataFrame:
        return by_jump.join(apart(by_jump.select(*by, F.col("__a").alias("__b"), F.col("__b").alias("__c"))), [*by, "__b"]).select(*by, "__a", F.col("__c").alias("__b"))

    while True:
        further = twice(jump)
        one = moved(found, jump)
        new = stored(one.unionByName(moved(found.unionByName(one), further)).distinct(), "follow")
        if new.isEmpty():
            return found.withColumnRenamed("__a", at)
        found = stored(found.unionByName(new).distinct(), "follow")
        jump = stored(twice(further), "jump")
