"""Planning: boundary safety and snapping, chunk plans, activity chunks, quota selection.

Candidates and scores are joins and windows; a choice that depends on the choice before it is
a fold per timeline in ``applyInPandas``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import apart, stored
from .intervals import Convention, complement, union
from .joins import asof, overlap_join, stabbing_join
from .scan import follow, numbered, running


def boundary_candidates(targets: DataFrame, hard: DataFrame, soft: DataFrame, by: list[str], id_col: str, radius, eps, bin_width=None) -> DataFrame:
    """Possible places of each target within ``radius`` (or, where the targets have them, between ``lower`` and ``upper``): the
    target, the ends of its window, just beside every edge inside it, and the middle of each stretch without hard events."""
    if "lower" in targets.columns:
        w = targets.select(*by, id_col, F.greatest("lower", F.least("upper", "target")).alias("target"), "lower", "upper")
    else:
        w = targets.select(*by, id_col, "target", (F.col("target") - F.lit(radius)).alias("lower"), (F.col("target") + F.lit(radius)).alias("upper"))
    w = apart(w)
    ends = w.select("*", F.explode(F.array("target", "lower", "upper")).alias("c"))
    both = hard.select(*by, "t_ini", "t_fin").unionByName(soft.select(*by, "t_ini", "t_fin"))
    edges = both.select(*by, F.explode(F.array("t_ini", "t_fin")).alias("edge")).distinct().withColumn("edge2", F.col("edge"))
    near = overlap_join(w, edges, by, ("lower", "upper"), ("edge", "edge2"), Convention.CLOSED, bin_width)
    beside = near.select(*w.columns, F.explode(F.array(F.greatest("lower", F.col("edge") - F.lit(eps)), F.least("upper", F.col("edge") + F.lit(eps)))).alias("c"))
    inner = overlap_join(w, hard.select(*by, F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin")), by, ("lower", "upper"), bin_width=bin_width)
    clipped = inner.select(*by, id_col, F.greatest("r_ini", "lower").alias("t_ini"), F.least("r_fin", "upper").alias("t_fin"))
    free = complement(union(clipped, [*by, id_col]), [*by, id_col], w.select(*by, id_col, F.col("lower").alias("lo"), F.col("upper").alias("hi")))
    middle = free.select(*by, id_col, ((F.col("t_ini") + F.col("t_fin")) / 2).alias("c")).join(w, [*by, id_col]).select(*w.columns, "c")
    return ends.unionByName(beside).unionByName(middle.withColumn("c", F.col("c").cast(dict(ends.dtypes)["c"]))).distinct()


def boundary_safety(candidates: DataFrame, hard: DataFrame, soft: DataFrame, by: list[str], c: str, reach, bin_width=None) -> DataFrame:
    """Adds hard and soft events that hold each candidate strictly, and the distance to the nearest
    edge of a hard event that doesn't, at most ``reach``.

    Candidates and the edges of events are one line: the events that hold a place are those begun before it less those ended until
    then, and the nearest that don't hold it are the last end until there and the first start from there on. So each row is shuffled once and
    nothing is paired. ``bin_width``: slices of the line, with one row of totals each that is carried over."""
    rows, counts = candidates.withColumns({"__c": F.col(c), "__side": F.lit(1)}), ("__hard", "__soft")
    there = F.lit(True)
    for k in by:
        there = there & F.col(k).isNotNull()
    edges = None
    for events, own in ((hard, "__hard"), (soft, "__soft")):
        # an event without length holds nothing, one that ends before it begins is no event of the line
        step = F.when(F.col("t_fin") > F.col("t_ini"), 1).otherwise(0)
        near = F.lit(own == "__hard")
        end = F.struct(F.col("t_fin").alias("t"), F.lit(0).alias("side"), (-step).alias("n"), F.when(near, F.col("t_fin")).alias("last"), F.when(F.lit(False), F.col("t_ini")).alias("next"))
        start = F.struct(F.col("t_ini").alias("t"), F.lit(2).alias("side"), step.alias("n"), F.when(F.lit(False), F.col("t_fin")).alias("last"), F.when(near, F.col("t_ini")).alias("next"))
        x = events.where(there & (F.col("t_fin") >= F.col("t_ini"))).select(*by, F.explode(F.array(end, start)).alias("x"))
        x = x.select(*by, F.col("x.t").alias("__c"), F.col("x.side").alias("__side"), F.col("x.n").alias(own), F.col("x.last").alias("__last"), F.col("x.next").alias("__next"))
        edges = x if edges is None else edges.unionByName(x, allowMissingColumns=True)
    both, keys = rows.unionByName(edges, allowMissingColumns=True), list(by)
    if bin_width is not None:
        keys, width = [*by, "__slice"], F.floor(F.col("__c") / F.lit(bin_width))
        both = both.withColumn("__slice", width)
        places = rows.select(*by, "__c").distinct().unionByName(edges, allowMissingColumns=True).withColumn("__slice", width)
        totals = places.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in counts), F.max("__last").alias("__last"), F.min("__next").alias("__next"))
    up = Window.partitionBy(*keys).orderBy("__c", "__side").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("__c"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, -1)
    found = {n: F.sum(n).over(up) for n in counts} | {"__last": F.last("__last", ignorenulls=True).over(up), "__next": F.last("__next", ignorenulls=True).over(down)}
    out = both.select(*candidates.columns, "__c", "__side", *keys[len(by) :], *(x.alias(f"_{n}") for n, x in found.items())).where("__side = 1")
    if bin_width is not None:
        earlier = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        later = Window.partitionBy(*by).orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
        carry = {n: F.sum(n).over(earlier) for n in counts} | {"__last": F.last("__last", ignorenulls=True).over(earlier), "__next": F.last("__next", ignorenulls=True).over(later)}
        out = out.join(apart(totals.select(*keys, *(x.alias(f"c{n}") for n, x in carry.items()))), keys, "left")
        out = out.withColumns({f"_{n}": F.coalesce(f"_{n}", F.lit(0)) + F.coalesce(f"c{n}", F.lit(0)) for n in counts} | {f"_{n}": F.coalesce(f"_{n}", f"c{n}") for n in ("__last", "__next")})
    clearance = F.least(F.col(c) - F.col("___last"), F.col("___next") - F.col(c), F.lit(reach))
    out = out.select(*candidates.columns, F.coalesce("___hard", F.lit(0)).alias("n_hard"), F.coalesce("___soft", F.lit(0)).alias("n_soft"), clearance.alias("clearance"))
    odd = hard.where("t_fin < t_ini")
    if odd.isEmpty():
        return out
    # events that end before they begin hold nothing, but count as near where both their edges are
    around = candidates.select(*by, c).distinct().withColumn("c_lo", F.col(c) - F.lit(reach)).withColumn("c_hi", F.col(c) + F.lit(reach))
    near = overlap_join(around, odd.select(*by, F.col("t_ini").alias("h_ini"), F.col("t_fin").alias("h_fin")), by, ("c_lo", "c_hi"), ("h_ini", "h_fin"), Convention.CLOSED, bin_width)
    dist = near.groupBy(*by, c).agg(F.min(F.least(F.abs(F.col(c) - F.col("h_ini")), F.abs(F.col(c) - F.col("h_fin")))).alias("__odd"))
    return out.join(dist, [*by, c], "left").withColumn("clearance", F.least("clearance", "__odd")).select(*out.columns)


def snap(targets: DataFrame, hard: DataFrame, soft: DataFrame, by: list[str], id_col: str, radius, eps, reach, bin_width=None) -> DataFrame:
    """The safest place near each target: fewest hard, then soft conflicts, then clearance up to
    ``reach``, then nearest, then earliest: (by, id, target, snapped, n_hard, n_soft)."""
    places = boundary_candidates(targets, hard, soft, by, id_col, radius, eps, bin_width)
    scored = boundary_safety(places if bin_width is None else stored(places, "snap"), hard, soft, by, "c", reach, bin_width)
    order = Window.partitionBy(*by, id_col).orderBy("n_hard", "n_soft", F.desc("clearance"), F.abs(F.col("c") - F.col("target")), "c")
    best = scored.withColumn("__r", F.row_number().over(order)).where("__r = 1")
    return best.select(*by, id_col, "target", F.col("c").alias("snapped"), "n_hard", "n_soft")


def chunk_plan(scored: DataFrame, by: list[str], t: str, score: str, bounds: DataFrame, target, longest, shortest, nearby=300_000) -> DataFrame:
    """Tiles each timeline: no fewer chunks than its length over ``target`` and over ``longest``, every inner boundary the best
    scored time near its ideal place (0.28 of a chunk, ``nearby`` at least) that keeps all chunks within limits: (by, chunk_no, t_ini, t_fin).

    A scored time is a candidate for the boundaries near it only. One round sets the boundary of the
    same number on all timelines at once, by a join and a maximum, which combine before the shuffle; a timeline
    without a candidate inside its limits is looked up among all its scored times. A null score counts as 0;
    null times and timelines without bounds take no part; a timeline without scored times is tiled evenly."""
    size = F.col("hi") - F.col("lo")
    line = bounds.select(*by, F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")).where(size.isNotNull())
    line = line.withColumn("n", F.greatest(F.lit(1), F.ceil(size / F.lit(target)), F.ceil(size / F.lit(longest))).cast("int")).withColumn("ideal", size / F.col("n"))
    line = stored(line.withColumn("least_len", F.least(F.lit(float(shortest)), 0.2 * F.col("ideal"))), "plan")
    points = stored(scored.select(*by, F.col(t).cast("double").alias("t"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s")).where("t IS NOT NULL"), "plan")
    reach = F.greatest(F.lit(float(nearby)), 0.28 * F.col("ideal"))
    first, last = F.ceil((F.col("t") - F.col("lo") - reach) / F.col("ideal")), F.floor((F.col("t") - F.col("lo") + reach) / F.col("ideal"))
    near = points.join(line, by).withColumn("k1", F.greatest(F.lit(1), first).cast("int")).withColumn("k2", F.least(F.col("n") - 1, last).cast("int"))
    near = stored(near.where("k1 <= k2").select(*by, F.explode(F.sequence("k1", "k2")).alias("k"), "t", "s"), "plan")
    rounds = line.agg(F.max("n")).first()[0] or 1
    state, edges = line.select(*by, F.lit(0).alias("k"), F.col("lo").alias("edge")), []
    for k in range(1, rounds):
        left = F.col("n") - k
        live = state.join(line.where(F.col("n") > k), by).withColumn("goal", F.col("lo") + F.col("ideal") * k)
        live = live.withColumn("low", F.greatest(F.col("edge") + F.col("least_len"), F.col("hi") - left * float(longest))).withColumn("high", F.least(F.col("edge") + float(longest), F.col("hi") - left * F.col("least_len")))
        live = live.select(*by, "goal", "low", "high", "ideal")

        def best(candidates: DataFrame, live: DataFrame = live) -> DataFrame:
            fits = candidates.join(live, by).where((F.col("t") > F.col("low")) & (F.col("t") < F.col("high")))
            worth = F.col("s") - 0.35 * F.abs(F.col("t") - F.col("goal")) / F.greatest(F.lit(1.0), F.col("ideal"))
            return fits.groupBy(*by).agg(F.max(F.struct(worth.alias("worth"), (-F.col("t")).alias("t"))).alias("best")).select(*by, (-F.col("best.t")).alias("chosen"))

        close = live.join(best(near.where(F.col("k") == k).drop("k")), by, "left")
        close = stored(close, "plan")
        lost = close.where("chosen IS NULL").select(*live.columns)
        if not lost.isEmpty():
            close = close.join(best(points, lost).withColumnRenamed("chosen", "other"), by, "left").withColumn("chosen", F.coalesce("chosen", "other"))
        state = close.select(*by, F.lit(k).alias("k"), F.coalesce("chosen", F.greatest("low", F.least("high", "goal"))).alias("edge"))
        edges.append(state)
    places = line.select(*by, F.lit(0).alias("k"), F.col("lo").alias("edge")).unionByName(line.select(*by, F.col("n").alias("k"), F.col("hi").alias("edge")))
    for e in edges:
        places = places.unionByName(e)
    places = stored(places, "plan")
    begin = places.select(*by, (F.col("k") + 1).alias("k"), F.col("edge").alias("t_ini"))
    return places.join(begin, [*by, "k"]).select(*by, F.col("k").alias("chunk_no"), "t_ini", F.col("edge").alias("t_fin"))


def snap_plan(plan: DataFrame, hard: DataFrame, soft: DataFrame, by: list[str], radius, eps, reach, longest, bin_width=None) -> DataFrame:
    """Moves the inner boundaries of a plan to safe places, in order: none before the one before it, none behind where the
    next one was meant, no chunk over ``longest``. plan: chunk_no from 1, t_ini, t_fin (whole numbers), without gaps.

    (by, chunk_no, target, snapped, n_hard, n_soft, error): one row for each chunk but the last, with the boundary at its end. ``error`` is
    ``no_room`` where the limits leave no place, and ``crosses`` where every place crosses a hard event; else null. All boundaries
    are snapped at once, by the limits that don't depend on the one before; where the boundary before moved so far that a limit does,
    the first such boundary of each timeline is snapped again, until none is left."""
    w = Window.partitionBy(*by).orderBy("chunk_no")
    line = plan.select(*by, "chunk_no", F.col("t_fin").cast("long").alias("target"), F.lead("t_fin").over(w).cast("long").alias("next"), F.max("t_fin").over(Window.partitionBy(*by)).cast("long").alias("hi"), F.count("*").over(Window.partitionBy(*by)).alias("n"), F.min("t_ini").over(Window.partitionBy(*by)).cast("long").alias("lo"))
    line = line.where("next IS NOT NULL")
    line = stored(line.withColumn("lower", F.greatest(F.col("target") - F.lit(radius), F.col("hi") - (F.col("n") - F.col("chunk_no")) * F.lit(longest))).withColumn("upper", F.least(F.col("next") - F.lit(eps), F.col("target") + F.lit(radius))), "snap")

    def snapped(rows: DataFrame) -> DataFrame:
        some = rows.where("lower <= upper")
        best = snap(some.select(*by, "chunk_no", "target", "lower", "upper"), hard, soft, by, "chunk_no", radius, eps, reach, bin_width).drop("target")
        return stored(rows.join(apart(best), [*by, "chunk_no"], "left"), "snap")

    done = snapped(line)
    while True:
        before = F.coalesce(F.lag("snapped").over(w), F.lag("target").over(w), "lo")
        # a boundary that has no room counts as staying where it was meant
        limits = done.withColumn("low", F.greatest("lower", before + F.lit(eps))).withColumn("high", F.least("upper", before + F.lit(longest)))
        moved = limits.where((F.col("low") > F.col("lower")) | (F.col("high") < F.col("upper")))
        first = stored(moved.groupBy(*by).agg(F.min_by(F.struct("chunk_no", "low", "high"), "chunk_no").alias("x")).select(*by, "x.*"), "snap")
        if first.isEmpty():
            break
        rows = line.drop("lower", "upper").join(apart(first.withColumnsRenamed({"low": "lower", "high": "upper"})), [*by, "chunk_no"])
        again = snapped(rows.select(*line.columns))
        done = stored(done.join(apart(first.select(*by, "chunk_no")), [*by, "chunk_no"], "left_anti").unionByName(again.select(*done.columns)), "snap")
    error = F.when(F.col("lower") > F.col("upper"), "no_room").when(F.col("n_hard") > 0, "crosses")
    return done.select(*by, "chunk_no", "target", F.coalesce("snapped", "target").alias("snapped"), "n_hard", "n_soft", error.alias("error"))


def snap_nested(items: DataFrame, hard: DataFrame, soft: DataFrame, by: list[str], id_col: str, parent: str, radius, eps, reach, bin_width=None) -> DataFrame:
    """Moves both ends of nested items to safe places, parents before children: a child stays inside its parent as that was moved.
    Items (t_ini, t_fin, whole numbers) have one range each. Adds s_ini, s_fin and ``crosses``; items on a cycle or under a missing parent are left out."""
    from .documents import depth

    level = stored(depth(items.select(*by, id_col, parent), by, id_col, parent).select(*by, id_col, "depth").where("depth IS NOT NULL").distinct(), "nested")
    rows = stored(items.join(apart(level), [*by, id_col]), "nested")
    out = None
    for k in range((level.agg(F.max("depth")).first()[0] or 0) + 1):
        own = rows.where(F.col("depth") == k)
        if out is None:
            own = own.withColumns({"p_ini": F.lit(None).cast("long"), "p_fin": F.lit(None).cast("long")})
        else:
            own = own.join(apart(out.select(*by, F.col(id_col).alias(parent), F.col("s_ini").alias("p_ini"), F.col("s_fin").alias("p_fin"))), [*by, parent])
        ends = own.select(*by, id_col, "p_ini", "p_fin", F.explode(F.array(F.struct(F.lit("a").alias("e"), F.col("t_ini").alias("t")), F.struct(F.lit("b").alias("e"), F.col("t_fin").alias("t")))).alias("x"))
        inside = lambda x: F.greatest(F.coalesce("p_ini", x), F.least(F.coalesce("p_fin", x), x))
        t = F.col("x.t").cast("long")
        edge = F.to_json(F.struct(F.col(id_col).alias("id"), "x.e"))
        targets = ends.select(*by, id_col, F.col("x.e").alias("e"), edge.alias("__edge"), inside(t).alias("target"), inside(t - F.lit(radius)).alias("lower"), inside(t + F.lit(radius)).alias("upper"))
        targets = stored(targets, "nested")
        best = targets.select(*by, id_col, "e", "__edge").join(apart(snap(targets, hard, soft, by, "__edge", radius, eps, reach, bin_width)), [*by, "__edge"])
        both = best.groupBy(*by, id_col).agg(F.max(F.when(F.col("e") == "a", F.col("snapped"))).alias("s_ini"), F.max(F.when(F.col("e") == "b", F.col("snapped"))).alias("s_fin"), (F.max("n_hard") > 0).alias("crosses"))
        done = stored(own.join(apart(both), [*by, id_col]).select(*items.columns, "s_ini", "s_fin", "crosses"), "nested")
        out = done if out is None else out.unionByName(done)
    return out


#: Whole units that an activity of 1 counts, so that sums are exact.
ACTIVITY = 1_000_000


def activity_chunks(samples: DataFrame, by: list[str], pos: str, value: str, budget: float, shortest: int, longest: int, back: int, cut: str | None = None, order: list[str] | None = None, slice_width=None, value_width=None) -> DataFrame:
    """Chunks of an activity curve: one closes at its budget (after ``shortest`` samples) or at ``longest``,
    stepping back at most ``back`` samples to the lowest value, and at a hard cut: (by, chunk_no, first, last, activity).

    Activity is relative to the curve (tenth percentile, upper median of what is above) or absolute,
    whichever is more, at most 3, in millionths. Samples marked ``cut`` are walls if they are ``shortest`` samples from the wall before and from the end.
    A chunk shorter than ``shortest`` that doesn't begin at a cut joins the one before.

    Where a chunk from any sample would end shows within the next ``longest`` samples; walls and chunks that exist
    are found by following these steps. A null value counts as 0, a null ``cut`` as false; samples without a position
    take no part. ``slice_width`` and ``value_width`` are the widths of slices of position and value that
    split long curves (none: one window a curve)."""
    names, by = by, [f"__by{k}" for k in range(len(by))]
    ties = [f"__o{k}" for k in range(len(order or []))]
    line = [*(F.col(c).alias(k) for c, k in zip(names, by, strict=True)), *(F.col(c).alias(k) for c, k in zip(order or [], ties, strict=True))]
    rows = samples.where(F.col(pos).isNotNull()).select(*line, F.col(pos).alias("pos"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("m"), F.coalesce(F.col(cut) if cut else F.lit(False), F.lit(False)).alias("cut"))
    rows = stored(numbered(rows, by, ["pos", *ties], "i", slice_width).drop("pos", *ties), "activity")
    size = rows.groupBy(*by).agg(F.count("*").alias("n"))
    ranked = stored(numbered(rows.select(*by, "m", "i"), by, ["m", "i"], "rank", value_width).join(size, by).select(*by, "m", "rank", "n"), "activity")
    floor = ranked.where(F.col("rank") == F.floor(0.1 * (F.col("n") - 1))).select(*by, F.col("m").alias("noise"))
    above = ranked.join(floor, by).groupBy(*by, "noise", "n").agg(F.count_if(F.col("m") > F.col("noise")).alias("above"))
    middle = above.withColumn("rank", F.col("n") - F.col("above") + F.expr("above div 2"))
    scale = middle.join(ranked.select(*by, "rank", "m"), [*by, "rank"], "left").select(*by, "n", "noise", F.greatest(F.when(F.col("above") > 0, F.col("m") - F.col("noise")).otherwise(1e-6), F.lit(1e-6)).alias("scale"))
    m = F.col("m")
    activity = F.least(F.greatest((m - F.col("noise")) / F.col("scale"), (m - 0.02) / 0.10, F.lit(0.0)), F.lit(3.0))
    rows = rows.join(scale, by).select(*by, "i", "m", "cut", "n", F.floor(activity * ACTIVITY + 0.5).cast("long").alias("a"))
    wide = None if slice_width is None else 4096

    zero = size.select(*by, F.lit(0).cast("long").alias("at"))
    cuts = rows.where((F.col("cut")) & (F.col("i") >= shortest) & (F.col("n") - F.col("i") >= shortest)).select(*by, "i", (F.col("i") + shortest).alias("reach"))
    walls = zero
    if cut:
        ahead = asof(cuts.unionByName(zero.select(*by, F.col("at").alias("i"), F.lit(shortest).cast("long").alias("reach"))), cuts.select(*by, F.col("i").alias("w")), by, "reach", "w", [], False, prefix="next_", slice_width=wide)
        walls = follow(ahead.select(*by, F.col("i").alias("at"), F.col("next_t").alias("to")), zero, by)
    walled = rows.join(walls.select(*by, F.col("at").alias("i"), F.lit(1).alias("wall")), [*by, "i"], "left")
    walled = stored(running(walled, by, ["i"], {"segment": ("sum", F.col("wall"))}, wide), "activity")

    # each stretch of ``deal`` samples with the ``longest`` samples after it, which is as far as a chunk looks
    deal = max(1024, longest)
    own = F.expr(f"i div {deal}")
    halo = F.when((F.col("i") % deal < longest) & (F.col("i") >= deal), F.array(own, own - 1)).otherwise(F.array(own))
    near = Window.partitionBy(*by, "segment", "part").orderBy("i").rowsBetween(0, longest - 1)
    seen = walled.withColumn("part", F.explode(halo)).withColumn("ahead", F.collect_list(F.struct("a", "m")).over(near)).where(F.col("part") == own)
    full = F.aggregate(
        "ahead", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("o"), F.lit(-1).alias("stop")),
        lambda s, x: F.struct((s["sum"] + x["a"]).alias("sum"), (s["o"] + 1).alias("o"), F.when((s["stop"] < 0) & (s["sum"] + x["a"] >= F.lit(int(round(budget * ACTIVITY)))) & (s["o"] + 1 >= shortest), s["o"]).otherwise(s["stop"]).alias("stop")),
    )
    seen = seen.withColumn("stop", full["stop"]).withColumn("o", F.when(F.col("stop") >= 0, F.col("stop")).otherwise(F.size("ahead") - 1))
    # a chunk that reaches the end of its segment doesn't step back
    seen = seen.join(walled.groupBy(*by, "segment").agg(F.max("i").alias("end")), [*by, "segment"])
    low = F.greatest(F.lit(shortest), F.col("o") - back)
    values = F.transform(F.slice("ahead", low + 1, F.greatest(F.lit(0), F.col("o") - low + 1)), lambda x: x["m"])
    seen = seen.withColumn("o", F.when((F.col("i") + F.col("o") < F.col("end")) & (low < F.col("o")), low + F.array_position(values, F.array_min(values)) - 1).otherwise(F.col("o")).cast("int"))
    total = F.aggregate(F.slice("ahead", 1, F.col("o") + 1), F.lit(0).cast("long"), lambda s, x: s + x["a"])
    seen = stored(seen.select(*by, F.col("i").alias("first"), (F.col("i") + F.col("o")).alias("last"), total.alias("a"), (F.col("cut") | (F.col("wall") == 1)).alias("held")), "activity")
    starts = follow(seen.select(*by, F.col("first").alias("at"), (F.col("last") + 1).alias("to")), zero, by)
    chunks = seen.join(starts.withColumnRenamed("at", "first"), [*by, "first"])
    joins = (F.col("last") - F.col("first") + 1 < shortest) & ~F.coalesce("held", F.lit(False)) & (F.col("first") > 0)
    chunks = running(chunks.withColumn("fresh", (~joins).cast("int")), by, ["first"], {"chunk_no": ("sum", F.col("fresh"))}, wide)
    out = chunks.groupBy(*by, F.col("chunk_no").cast("int").alias("chunk_no")).agg(F.min("first").cast("int").alias("first"), F.max("last").cast("int").alias("last"), (F.sum("a") / ACTIVITY).alias("activity"))
    return out.select(*(F.col(k).alias(c) for c, k in zip(names, by, strict=True)), "chunk_no", "first", "last", "activity")


def clashes(rows: DataFrame, others: DataFrame, by: list[str], spacing, bin_width=None, shared: bool = True) -> DataFrame:
    """(by, a, b): ranks of rows and of others that lie less than ``spacing`` apart or (if ``shared``) share an entry of ``shared``;
    a pair may come more than once."""
    rows = apart(rows)
    left = rows.select(*by, F.col("rank_no").alias("a"), (F.col("t_ini") - F.lit(spacing)).alias("l_ini"), (F.col("t_fin") + F.lit(spacing)).alias("l_fin"))
    right = others.select(*by, F.col("rank_no").alias("b"), F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"))
    near = overlap_join(left, right, by, ("l_ini", "l_fin"), convention=Convention.OPEN, bin_width=bin_width).select(*by, "a", "b").where("a <> b")
    if not shared:
        return near
    mine = rows.select(*by, F.col("rank_no").alias("a"), F.explode("shared").alias("x"))
    theirs = others.select(*by, F.col("rank_no").alias("b"), F.explode("shared").alias("x"))
    return near.unionByName(mine.join(theirs, [*by, "x"]).select(*by, "a", "b").where("a <> b"))


def quota_select(pool: DataFrame, by: list[str], lane: str, rank: str, lane_order: list[str], quotas: dict[str, int], spacing, always: str | None = None, shared: str | None = None, scale: DataFrame | None = None, bin_width=None) -> DataFrame:
    """Selection by quotas: lanes in order, the best first; a row is refused as duplicate if it is within ``spacing`` of an
    accepted one or has an entry of ``shared`` in common with it, and for the quota if its lane's is full; rows with ``always`` enter first, without quota.
    (by, id, lane, t_ini, t_fin, rank, accepted, why).

    Each lane is chosen by rounds, on all timelines at once, among what doesn't clash with the lanes before; its quota then
    takes the first of the chosen. ``scale`` (by, scale) multiplies the quotas (rounded, 1 at least). Lanes without a quota have 99; those
    outside ``lane_order`` come last, together, and have none. Rows without a time or an id take no part."""
    from .greedy import ranked, refused

    empty = F.array().cast("array<string>")
    rows = pool.where("id IS NOT NULL AND t_ini IS NOT NULL AND t_fin IS NOT NULL").select(
        *by, "id", F.col(lane).alias("lane"), "t_ini", "t_fin", F.col(rank).cast("double").alias("rank"), F.coalesce(F.col(always) if always else F.lit(False), F.lit(False)).alias("always"),
        F.coalesce(F.transform(F.col(shared), lambda x: x.cast("string")), empty).alias("shared") if shared else empty.alias("shared"),
    )
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(lane_order) for x in (n, i)]), F.col("lane")), F.lit(len(lane_order))) if lane_order else F.lit(0)
    rows = rows.withColumn("lane_no", F.when(F.col("always"), -1).otherwise(place))
    full = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, q in quotas.items() for x in (n, q)]), F.col("lane")), F.lit(99)) if quotas else F.lit(99)
    rows = ranked(rows, by, ["lane_no", F.desc("rank"), "t_ini", "id"]).withColumn("quota", F.when(F.col("lane_no") < len(lane_order), full).otherwise(2**31 - 1))
    if scale is not None:
        rows = rows.join(apart(scale.select(*by, "scale")), by, "left").withColumn("quota", F.greatest(F.lit(1), F.rint(F.col("quota") * F.coalesce("scale", F.lit(1.0))).cast("int"))).drop("scale")
    rows = stored(rows, "quota")
    taken = rows.where("always")
    for k in [r["lane_no"] for r in rows.where("NOT always").select("lane_no").distinct().orderBy("lane_no").collect()]:  # the lanes named, and one more
        own = rows.where((F.col("lane_no") == k) & ~F.col("always"))
        blocked = clashes(own, taken, by, spacing, bin_width, shared is not None).select(*by, F.col("a").alias("rank_no")).distinct()
        free = stored(own.join(apart(blocked), [*by, "rank_no"], "left_anti"), "quota")
        left = free.join(apart(refused(clashes(free, free, by, spacing, bin_width, shared is not None), by, "a", "b")), [*by, "rank_no"], "left_anti")
        first = left.withColumn("place", F.row_number().over(Window.partitionBy(*by, "lane").orderBy("rank_no"))).where("place <= quota").drop("place")
        taken = stored(taken.unionByName(first.select(*taken.columns)), "quota")
    # refused rows: near an accepted one that came before them, or else over the quota
    refusals = rows.join(apart(taken.select(*by, "rank_no")), [*by, "rank_no"], "left_anti")
    near = clashes(refusals, taken, by, spacing, bin_width, shared is not None).where("b < a").select(*by, F.col("a").alias("rank_no")).distinct().withColumn("why", F.lit("duplicate"))
    refusals = refusals.join(apart(near), [*by, "rank_no"], "left").withColumn("why", F.coalesce("why", F.lit("quota"))).withColumn("accepted", F.lit(False))
    out = taken.withColumn("why", F.lit(None).cast("string")).withColumn("accepted", F.lit(True)).unionByName(refusals, allowMissingColumns=True)
    return out.select(*by, "id", "lane", "t_ini", "t_fin", "rank", "accepted", "why")


def pack_first_fit(protected: DataFrame, new: DataFrame, by: list[str], order: str) -> DataFrame:
    """Places new clips (id, len) one after the other into the free room around protected clips."""
    rows = protected.select(*by, F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("o"), "seq_ini", "seq_fin").unionByName(new.select(*by, F.col("id").cast("long").alias("id"), F.col(order).cast("long").alias("o"), F.lit(0).cast("long").alias("seq_ini"), F.col("len").cast("long").alias("seq_fin")))
    types = dict(rows.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = sorted(zip(pdf["seq_ini"][pdf["id"].isna()], pdf["seq_fin"][pdf["id"].isna()], strict=True))
        cursor, at, out = 0, 0, []
        for r in pdf[pdf["id"].notna()].sort_values(["o", "id"]).itertuples():
            while at < len(held) and cursor + r.seq_fin > held[at][0]:  # what lies before the cursor is behind for good
                cursor = max(cursor, held[at][1])
                at += 1
            out.append((*key, int(r.id), int(cursor), int(cursor + r.seq_fin)))
            cursor += r.seq_fin
        return pd.DataFrame(out, columns=[*by, "id", "seq_ini", "seq_fin"])

    return rows.groupBy(*by).applyInPandas(run, f"{keys}, id long, seq_ini long, seq_fin long")
