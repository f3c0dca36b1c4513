"""Joins on time: overlap, stabbing, as-of, nearest, and what is built from them.

Spark has no range join, so an overlap join is an equi-join. With ``bin_width`` intervals have a level by
their length; the cells of a level are as wide as its longest interval, so an interval touches one
or two cells of its own level and of every longer one. Of a pair the longer interval lies in its cells and the shorter looks for
it there, and it is kept only in the first cell that both touch, so there is no ``distinct``, and an event of
ten years costs as many rows as one of a second. AQE can split a hot cell. The levels there are come from one
aggregation of the lengths. Without ``bin_width`` the timelines' columns ``by`` alone are the key, right for short timelines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import same_identity
from ..sources.scratch import apart, stored
from .intervals import Convention, meets, overlap_length


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], l_cols: tuple[str, str] = ("t_ini", "t_fin"), r_cols: tuple[str, str] = ("r_ini", "r_fin"), convention: Convention = Convention.OPEN, bin_width=None, how: str = "inner") -> DataFrame:
    """Pairs whose intervals meet. ``how``: inner, left, left_semi or left_anti. Columns other than ``by`` must differ."""
    (ls, le), (rs, re) = l_cols, r_cols
    condition = meets(rs, re, ls, le, convention)
    if bin_width is None:
        right = right.withColumnsRenamed({c: f"__r_{c}" for c in by})
        on = condition
        for c in by:
            on = on & (left[c] == right[f"__r_{c}"])
        out = left.join(right, on, how)
        return out.drop(*(f"__r_{c}" for c in by)) if how in ("inner", "left") else out
    if how != "inner":
        keys = [*by, ls, le]
        if how == "left":
            hits = stored(overlap_join(left, right, by, l_cols, r_cols, convention, bin_width), "overlap")
            # keys that are null meet nothing
            missing = left.join(hits.select(*keys).distinct(), keys, "left_anti")
            return hits.unionByName(missing, allowMissingColumns=True)
        hits = overlap_join(left.select(*keys).distinct(), right.select(*by, rs, re), by, l_cols, r_cols, convention, bin_width).select(*keys).distinct()
        return left.join(hits, keys, how)
    l, r = left.withColumn("__level", _level(ls, le, bin_width)), right.withColumn("__level", _level(rs, re, bin_width))
    held = l.select(F.lit(0).alias("side"), "__level").unionByName(r.select(F.lit(1).alias("side"), "__level")).where("__level IS NOT NULL").distinct().collect()  # a few numbers
    seen = [sorted(x["__level"] for x in held if x["side"] == k) for k in (0, 1)]
    l_own, r_own = _own(l, "l", ls, le, bin_width), _own(r, "r", rs, re, bin_width)
    out = None
    # the longer interval lies in one or two cells of its level, the shorter one looks there
    for mine, own, other, probe in ((l_own, seen[0], r, ("r", rs, re)), (r_own, seen[1], l, ("l", ls, le))):
        longer = probe[0] == "r"
        levels = [x for x in own if any(y < x if longer else y <= x for y in (seen[1] if longer else seen[0]))]
        if not levels:
            continue
        looks = F.filter(F.array(*map(F.lit, levels)), lambda x: (F.col("__level") < x) if longer else (F.col("__level") <= x))
        near = other.withColumn("__cell_level", F.explode(looks))
        near = _cells(near, probe[0], F.floor(F.col(probe[1]) / _width("__cell_level", bin_width)), F.floor(F.col(probe[2]) / _width("__cell_level", bin_width)))
        pair = mine.join(near, [*by, "__cell_level", "__bin"]).where(condition & (F.col("__bin") == F.greatest("__l0", "__r0")))
        pair = pair.select(*left.columns, *(c for c in right.columns if c not in by))
        out = pair if out is None else out.unionByName(pair)
    if out is None:
        nothing = left.join(right.limit(0), by)
        return nothing.select(*left.columns, *(c for c in right.columns if c not in by))
    return out


def _level(start: str, end: str, bin_width):
    """0 for intervals up to ``bin_width``, 1 up to four times that, and so on; null where an end is."""
    length = F.greatest(F.lit(1.0), (F.col(end) - F.col(start)) / F.lit(bin_width))
    return F.when(length.isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull(), F.ceil(F.log2(length) / 2 - 1e-9)).cast("int")


def _width(level: str, bin_width):
    return F.lit(bin_width) * F.pow(F.lit(4.0), F.col(level))


def _cells(df: DataFrame, side: str, first, last) -> DataFrame:
    """A row for each cell from the first to the last; none where a bound is null, one where they are reversed."""
    return df.withColumn(f"__{side}0", first).withColumn("__bin", F.explode(F.sequence(f"__{side}0", F.greatest(F.col(f"__{side}0"), last)))).drop("__level")


def _own(df: DataFrame, side: str, start: str, end: str, bin_width) -> DataFrame:
    df = df.withColumn("__cell_level", F.col("__level"))
    return _cells(df, side, F.floor(F.col(start) / _width("__cell_level", bin_width)), F.floor(F.col(end) / _width("__cell_level", bin_width)))


def stabbing_join(points: DataFrame, spans: DataFrame, by: list[str], t: str = "t", s_cols: tuple[str, str] = ("t_ini", "t_fin"), convention: Convention = Convention.STAB, bin_width=None, how: str = "inner") -> DataFrame:
    """Points with the intervals that hold them."""
    return overlap_join(points, spans, by, (t, t), s_cols, convention, bin_width, how)


def conflicts(points: DataFrame, spans: DataFrame, by: list[str], track: str, bin_width=None) -> DataFrame:
    """For each point how many intervals hold it strictly, and of which tracks."""
    hit = stabbing_join(points, spans, by, bin_width=bin_width)
    found = hit.groupBy(*by, "t").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set(track)), ",").alias("tracks"))
    out = points.select(*by, "t").distinct().join(found, [*by, "t"], "left")
    return out.select(*by, "t", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.coalesce("tracks", F.lit("")).alias("tracks"))


def asof(left: DataFrame, right: DataFrame, by: list[str], l_t: str, r_t: str, values: list[str], backward: bool = True, exact: bool = True, tolerance=None, prefix: str = "", slice_width=None) -> DataFrame:
    """The last row of ``right`` not after each row of ``left`` (forward: the first not before).

    One union and one window, no pairs: a timeline of any density costs a sort. Among equal
    times of ``right`` the row with the largest values wins backward, the smallest forward.
    With ``slice_width`` the window runs inside slices of time, and what an earlier (later) slice has last
    (first) is carried over, so a timeline that holds a third of all rows is many tasks."""
    kept = F.struct(F.col(r_t).alias("t"), *(F.col(v) for v in values))
    rows = left.withColumn("__t", F.col(l_t)).withColumn("__side", F.lit(1 if exact == backward else 0)).withColumn("__v", F.lit(None).cast(right.select(kept.alias("k")).schema[0].dataType))
    more = right.select(*by, F.col(r_t).alias("__t"), F.lit(0 if exact == backward else 1).alias("__side"), kept.alias("__v"))
    both = rows.unionByName(more, allowMissingColumns=True).withColumn("__left", F.col("__v").isNull())
    keys = list(by)
    if slice_width is not None:
        keys, both = [*by, "__slice"], both.withColumn("__slice", F.floor(F.col("__t") / F.lit(slice_width)))
    w = Window.partitionBy(*keys).orderBy("__t", "__side", "__v")
    # a forward search is a backward one in the reverse order, which keeps the frame growing
    if not backward:
        w = Window.partitionBy(*keys).orderBy(F.desc("__t"), F.desc("__side"), F.desc("__v"))
    out = both.withColumn("__f", F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).where("__left")
    if slice_width is not None:
        edge = F.max("__r") if backward else F.min("__r")
        ends = both.where(~F.col("__left")).withColumn("__r", F.struct("__t", "__v")).groupBy(*keys).agg(edge["__v"].alias("__e"))
        places = both.select(*keys).distinct().join(apart(ends), keys, "left")
        line = Window.partitionBy(*by).orderBy("__slice" if backward else F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
        carry = places.select(*keys, F.last("__e", ignorenulls=True).over(line).alias("__carry"))
        out = out.join(apart(carry), keys, "left").withColumn("__f", F.coalesce("__f", "__carry"))
    near = F.lit(True) if tolerance is None else F.abs(F.col("__f.t") - F.col("__t")) <= F.lit(tolerance)
    fields = [F.when(near, F.col(f"__f.{c}")).alias(f"{prefix}{c}") for c in ("t", *values)]
    return out.select(*left.columns, *fields)


def nearest(left: DataFrame, right: DataFrame, by: list[str], l_t: str, r_t: str, values: list[str], radius=None) -> DataFrame:
    """The row of ``right`` nearest in time; ties go to the earlier one."""
    back = asof(left, right, by, l_t, r_t, values, True, prefix="b_")
    both = asof(back, right, by, l_t, r_t, values, False, prefix="f_")
    left_first = F.col("f_t").isNull() | ((F.col(l_t) - F.col("b_t")) <= (F.col("f_t") - F.col(l_t)))
    use = F.col("b_t").isNotNull() & left_first
    out = both.select(*left.columns, *(F.when(use, F.col(f"b_{c}")).otherwise(F.col(f"f_{c}")).alias(f"near_{c}") for c in ("t", *values)))
    if radius is None:
        return out
    ok = F.abs(F.col("near_t") - F.col(l_t)) <= F.lit(radius)
    return out.select(*left.columns, *(F.when(ok, F.col(f"near_{c}")).alias(f"near_{c}") for c in ("t", *values)))


def assign_by_overlap(items: DataFrame, turns: DataFrame, by: list[str], id_col: str, speaker: str, max_gap, bin_width=None) -> DataFrame:
    """Each item gets the speaker of the largest summed overlap (``overlap``), else the nearest
    turn within ``max_gap`` of its midpoint (``nearest``), else none (``unknown``). Ties: the
    speaker whose turn begins first, then by name."""
    wide = items.select(*by, id_col, "t_ini", "t_fin", (F.col("t_ini") - F.lit(max_gap)).alias("w_ini"), (F.col("t_fin") + F.lit(max_gap)).alias("w_fin"))
    turned = turns.select(*by, F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"), F.col(speaker).alias("speaker_id"))
    near = overlap_join(wide, turned, by, ("w_ini", "w_fin"), ("r_ini", "r_fin"), Convention.CLOSED, bin_width)
    mid = (F.col("t_ini") + F.col("t_fin")) / 2
    near = near.withColumn("ov", overlap_length("t_ini", "t_fin", "r_ini", "r_fin")).withColumn("dist", F.greatest(F.col("r_ini") - mid, mid - F.col("r_fin"), F.lit(0.0)))
    per = near.groupBy(*by, id_col, "speaker_id").agg(F.sum("ov").alias("ov"), F.min("r_ini").alias("since"), F.min(F.struct("dist", "r_ini")).alias("near"))
    best = Window.partitionBy(*by, id_col).orderBy(F.desc("ov"), "since", "speaker_id")
    close = Window.partitionBy(*by, id_col).orderBy("near.dist", "near.r_ini", "speaker_id")
    ranked = per.withColumn("r_ov", F.row_number().over(best)).withColumn("r_near", F.row_number().over(close))
    pick = ranked.groupBy(*by, id_col).agg(
        F.max(F.when((F.col("r_ov") == 1) & (F.col("ov") > 0), F.col("speaker_id"))).alias("over"),
        F.max(F.when((F.col("r_near") == 1) & (F.col("near.dist") <= F.lit(max_gap)), F.col("speaker_id"))).alias("near"),
    )
    how = F.when(F.col("over").isNotNull(), "overlap").when(F.col("near").isNotNull(), "nearest").otherwise("unknown")
    return items.join(pick, [*by, id_col], "left").withColumn("speaker_id", F.coalesce("over", "near")).withColumn("assignment", how).drop("over", "near")


def weighted_mean(items: DataFrame, signal: DataFrame, by: list[str], id_col: str, value: str, bin_width=None) -> DataFrame:
    """Mean of a windowed signal over each item, weighted by overlap; null if nothing meets the item, NaN if what
    does has no common time with it (an item without length)."""
    s = signal.select(*by, F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"), F.col(value).alias("__v"))
    hit = overlap_join(items.select(*by, id_col, "t_ini", "t_fin"), s, by, bin_width=bin_width).where("__v is not null")
    ov = overlap_length("t_ini", "t_fin", "r_ini", "r_fin")
    share = F.when(F.sum(ov) == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.sum(ov * F.col("__v")), F.sum(ov)))
    mean = hit.groupBy(*by, id_col).agg(share.alias(f"{value}_mean"), F.count("*").alias("n_windows"))
    return items.select(*by, id_col).join(mean, [*by, id_col], "left").withColumn("n_windows", F.coalesce("n_windows", F.lit(0)))


def best_container(items: DataFrame, spans: DataFrame, by: list[str], id_col: str, span_id: str, bin_width=None) -> DataFrame:
    """The span with the largest overlap of each item; ties go to the earlier span."""
    s = spans.select(*by, F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"), span_id)
    hit = overlap_join(items.select(*by, id_col, "t_ini", "t_fin"), s, by, bin_width=bin_width)
    w = Window.partitionBy(*by, id_col).orderBy(F.desc(overlap_length("t_ini", "t_fin", "r_ini", "r_fin")), "r_ini", span_id)
    top = hit.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*by, id_col, span_id)
    return items.select(*by, id_col).join(top, [*by, id_col], "left")


def pair_conflicts(df: DataFrame, by: list[str], id_col: str, left, right, bin_width=None) -> DataFrame:
    """Intersections of the rows that satisfy ``left`` with those that satisfy ``right``."""
    a = df.where(left).select(*by, F.col(id_col).alias("left_id"), "t_ini", "t_fin")
    b = df.where(right).select(*by, F.col(id_col).alias("right_id"), F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"))
    hit = overlap_join(a, b, by, bin_width=bin_width)
    return hit.select(*by, "left_id", "right_id", F.greatest("t_ini", "r_ini").alias("x_ini"), F.least("t_fin", "r_fin").alias("x_fin"))


def rectangle_overlap(a: tuple[str, str, str, str], b: tuple[str, str, str, str]):
    """Struct x, y, w, h of the common part of two rectangles (x, y, w, h), or null."""
    ax, ay, aw, ah = map(F.col, a)
    bx, by_, bw, bh = map(F.col, b)
    x0, y0, x1, y1 = F.greatest(ax, bx), F.greatest(ay, by_), F.least(ax + aw, bx + bw), F.least(ay + ah, by_ + bh)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))


#: Pairs of a cell of ``keyed_pairs``, right rows of one, and the most tasks that make pairs.
CELL, BLOCK, TASKS = 1 << 23, 512, 10_000


def keyed_pairs(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], size: int | None = None, block: int | None = None) -> DataFrame:
    """All pairs of rows of one identity (null is null's), for keys with so many rows on both sides that there are far more pairs
    than rows. Spark deals tasks by what they read, so a few tasks would make all pairs; here a key's pairs are cells of about ``size``,
    slices of its left rows by blocks of about ``block`` right rows (equal rows share one). A left row is copied for each block, a right row for
    each slice, so there is about one copy for ``block`` pairs. The pairs of a left row in a cell come one after the other, with the right rows
    in the order of the row before, so a pair takes a fraction of a byte in a Parquet file. Column names must differ."""
    size, block = size or CELL, block or BLOCK

    def key(df: DataFrame, names: list[str]) -> Column:
        # in structs null is equal to null; the cast makes them one type, whether a column can be null or not
        fields = {f"k{i}": (F.col(c), dict(df.dtypes)[c]) for i, c in enumerate(names)} | {p: (F.col(f"__{p}"), "int") for p in ("slice", "block")}
        return F.struct(*(c.alias(p) for p, (c, _) in fields.items())).cast(f"struct<{','.join(f'{p}:{kind}' for p, (_, kind) in fields.items())}>")

    def place(df: DataFrame, on: list[str], own: str, other: str) -> DataFrame:
        """One place among its own kind, copies for all of the other."""
        held = cells.select(*(F.col(c).alias(f"__{c}") for c in on), F.col("slice").alias("__slices"), F.col("block").alias("__blocks"))
        met = df.join(held, same_identity(on, [f"__{c}" for c in on]))
        met = met.withColumn(f"__{own}", F.pmod(F.xxhash64(*df.columns), F.col(f"__{own}s")).cast("int"))
        met = met.withColumn(f"__{other}", F.explode(F.sequence(F.lit(0), F.col(f"__{other}s") - 1)))
        return met.select(*df.columns, key(df, on).alias(f"__{own}")).repartition(tasks, f"__{own}")

    l_rows, r_rows = left.groupBy(*left_on).agg(F.count("*").alias("__l")), right.groupBy(*right_on).agg(F.count("*").alias("__r"))
    parts = [(F.floor(F.col(c) / n) + 1).cast("int").alias(name) for c, n, name in (("__l", max(1, size // block), "slice"), ("__r", block, "block"))]
    cells = stored(l_rows.join(r_rows, same_identity(left_on, right_on)).select(*left_on, *right_on, (F.col("__l") * F.col("__r")).alias("n"), *parts), "cells")
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = min(total // (2 * size) + 1, TASKS)
    l, r = place(left, left_on, "slice", "block"), place(right, right_on, "block", "slice")
    return l.join(apart(r), F.col("__slice") == F.col("__block")).select(*left.columns, *right.columns)
