"""Edit documents as tables: cuts, layers, marks and clips, their rules, merges and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import apart, stored

from .intervals import Convention, islands, meets
from .joins import overlap_join


def rule_errors(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule: (keys, rule). A rule is a condition that must hold; null breaks it."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def quarantine(df: DataFrame, by: list[str], id_col: str, order: list[str], rules: dict[str, Column]) -> DataFrame:
    """Adds ``reason``: the first broken rule, or duplicate_id for all but the first of an id."""
    first = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()], F.lit(None).cast("string"))
    marked = df.withColumn("reason", first)
    nth = F.row_number().over(Window.partitionBy(*by, id_col, F.col("reason").isNull()).orderBy(*order))
    return marked.withColumn("__n", nth).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("__n") > 1), F.lit("duplicate_id")).otherwise(F.col("reason"))).drop("__n")


def valid_range(s: str, e: str, lo, hi, tolerance=0.01) -> Column:
    """Finite, not negative, in order and inside the medium."""
    a, b = F.col(s), F.col(e)
    return a.isNotNull() & b.isNotNull() & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double")) & (a >= lo) & (b > a) & (b <= hi + F.lit(tolerance))


def stream_contract(df: DataFrame, by: list[str], pos: str, hi, tolerance) -> DataFrame:
    """Rows that break the time contract of a stream, with the reason."""
    w = Window.partitionBy(*by).orderBy(pos)
    back = F.coalesce(F.col("t_ini") < F.lag("t_ini").over(w) - F.lit(tolerance), F.lit(False))
    reason = F.when(F.col("t_ini").isNull() | F.col("t_fin").isNull(), "missing").when(F.col("t_fin") < F.col("t_ini"), "ends_before_start").when((F.col("t_ini") < -F.lit(tolerance)) | (F.col("t_fin") > hi + F.lit(tolerance)), "out_of_range").when(back, "goes_back")
    return df.withColumn("reason", reason).where("reason is not null")


def tiling_errors(chunks: DataFrame, by: list[str], id_col: str, bounds: DataFrame, tolerance, longest) -> DataFrame:
    """Where chunks do not tile their bounds: gaps, overlaps, wrong ends, too long."""
    w = Window.partitionBy(*by).orderBy("t_ini", "t_fin")
    c = chunks.join(bounds, by).withColumn("__prev", F.lag("t_fin").over(w)).withColumn("__last", F.lead("t_ini").over(w).isNull())
    rules = {
        "starts_late": F.col("__prev").isNotNull() | (F.abs(F.col("t_ini") - F.col("lo")) <= tolerance),
        "gap_or_overlap": F.col("__prev").isNull() | (F.abs(F.col("t_ini") - F.col("__prev")) <= tolerance),
        "ends_early": ~F.col("__last") | (F.abs(F.col("t_fin") - F.col("hi")) <= tolerance),
        "too_long": F.col("t_fin") - F.col("t_ini") <= F.lit(longest),
    }
    return rule_errors(c, [*by, id_col], rules)


def same_track_overlaps(clips: DataFrame, by: list[str], id_col: str, s: str = "seq_ini", e: str = "seq_fin") -> DataFrame:
    """Clips that begin before an earlier clip of their track has ended."""
    w = Window.partitionBy(*by).orderBy(s, e, id_col)
    reach = F.max(e).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return clips.withColumn("__r", reach).where(F.col("__r") > F.col(s)).select(*by, id_col, (F.col("__r") - F.col(s)).alias("overlap"))


def coalesce_cuts(cuts: DataFrame, by: list[str], id_col: str, reason: str) -> DataFrame:
    """Merges strictly overlapping cuts of each lane and state (``by``); the longest (ties: the
    larger id) survives, reasons are joined without repeats, its own first."""
    runs = islands(cuts, by, touching=False, order=[id_col])
    size = F.struct((F.col("t_fin") - F.col("t_ini")).alias("len"), F.col(id_col).alias("id"))
    best = Window.partitionBy(*by, "island").orderBy(F.desc(size))
    ranked = runs.withColumn("__first", (F.row_number().over(best) != 1).cast("int"))
    texts = F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("__first", "t_ini", "t_fin", id_col, reason))), lambda x: x[reason]), lambda x: x.isNotNull()))
    return ranked.groupBy(*by, "island").agg(F.max(size)["id"].alias(id_col), F.min("t_ini").alias("t_ini"), F.max("t_fin").alias("t_fin"), F.array_join(texts, " · ").alias(reason), F.count("*").alias("n_merged")).drop("island")


def merge_analysis(old: DataFrame, new: DataFrame, by: list[str], id_col: str, next_id: Column) -> DataFrame:
    """New cuts against old ones: those that meet an edited old cut are skipped, exact repeats keep
    id and state, edited old cuts stay, the others get fresh ids. old: id, t_ini, t_fin,
    enabled, edited; new: t_ini, t_fin, enabled."""
    edited = old.where("edited")
    guard = edited.select(*by, F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"))
    fresh = overlap_join(new, guard, by, how="left_anti")
    known = old.where("not edited").select(*by, "t_ini", "t_fin", F.col(id_col).alias("__id"), F.col("enabled").alias("__on"))
    both = fresh.join(known, [*by, "t_ini", "t_fin"], "left")
    w = Window.partitionBy(*by, F.col("__id").isNull()).orderBy("t_ini", "t_fin")
    both = both.withColumn(id_col, F.coalesce("__id", next_id + F.row_number().over(w) - 1)).withColumn("enabled", F.coalesce("__on", "enabled"))
    status = F.when(F.col("__id").isNotNull(), "kept").otherwise("new")
    added = both.select(*by, id_col, "t_ini", "t_fin", "enabled", status.alias("status"))
    return added.unionByName(edited.select(*by, id_col, "t_ini", "t_fin", "enabled", F.lit("edited").alias("status")))


def replace_lane(document: DataFrame, proposal: DataFrame, untouched: Column) -> DataFrame:
    """The rows of a lane that nobody touched give way to a proposal."""
    return document.where(~F.coalesce(untouched, F.lit(False))).unionByName(proposal, allowMissingColumns=True)


def depth(items: DataFrame, by: list[str], id_col: str, parent: str, deepest: int = 32) -> DataFrame:
    """Adds the depth of each item (roots 0), null for items on a cycle, under a missing parent or
    below ``deepest``. Each item looks at ancestors twice as far away in each round; only those that
    haven't reached a root go on, so no key is hot and the rounds grow with the logarithm of ``deepest``."""
    up, own = F.col(parent), [*by, F.col(id_col).alias("__id")]
    known = items.where(up.isNull() & F.col(id_col).isNotNull()).select(*own, F.lit(0).alias("depth"))
    steps = stored(items.where(up.isNotNull()).select(*own, up.alias("__up"), F.lit(1).alias("__n")), "depth")
    known = stored(known, "depth")
    done = known
    for _ in range(max(1, deepest).bit_length()):
        if steps.isEmpty():
            break
        above = done.select(*by, F.col("__id").alias("__up"), F.lit(None).cast(items.schema[id_col].dataType).alias("__far"), F.col("depth").alias("__m"))
        above = above.unionByName(steps.select(*by, F.col("__id").alias("__up"), F.col("__up").alias("__far"), F.col("__n").alias("__m")))
        moved = steps.join(above.hint("merge"), [*by, "__up"]).select(*by, "__id", F.col("__far").alias("__up"), (F.col("__n") + F.col("__m")).alias("__n"))
        moved = stored(moved.where(F.col("__n") <= deepest), "depth")
        done = done.unionByName(moved.where("__up IS NULL").select(*by, "__id", F.col("__n").alias("depth")))
        steps = moved.where("__up IS NOT NULL")
    return items.join(done.withColumnRenamed("__id", id_col).hint("merge"), [*by, id_col], "left")


def descendants(items: DataFrame, roots: DataFrame, by: list[str], id_col: str, parent: str) -> DataFrame:
    """The roots and all items below them (by, id), at any depth: each item looks at ancestors twice as far away
    in each round, so rounds grow with the logarithm of the depth. Items on a cycle without a root aren't below one.

    Items that are below a root, or have no ancestor left to look at, take no further part but as ancestors of others; so
    the many without an ancestor aren't one key."""
    marked = roots.select(*by, id_col).distinct().withColumn("__hit", F.lit(True))
    rows = items.select(*by, id_col, F.col(parent).alias("__up")).distinct().join(marked, [*by, id_col], "full_outer")
    rows = stored(rows.withColumn("__hit", F.coalesce("__hit", F.lit(False))), "descendants")
    live = rows.where("__up is not null and not __hit")
    hits = rows.where("__hit").select(*by, id_col).distinct()
    for _ in range(rows.count().bit_length() + 1):
        if live.isEmpty():
            break
        above = live.select(*by, F.col(id_col).alias("__up"), F.col("__up").alias("__far"), F.lit(False).alias("__above"))
        above = above.unionByName(hits.select(*by, F.col(id_col).alias("__up"), F.lit(None).cast(items.schema[parent].dataType).alias("__far"), F.lit(True).alias("__above")))
        moved = live.join(above.hint("merge"), [*by, "__up"]).select(*by, id_col, F.col("__far").alias("__up"), F.col("__above").alias("__hit")).distinct()
        moved = stored(moved, "descendants")
        hits = hits.unionByName(moved.where("__hit").select(*by, id_col))
        live = moved.where("__up is not null and not __hit")
    return hits.distinct()


def merge_layer(stored: DataFrame, proposed: DataFrame, by: list[str], id_col: str, parent: str) -> DataFrame:
    """Edited stored items stay; tombstones remove proposed items and all below them; all other
    stored items give way to the proposal. stored has edited, deleted."""
    dead = descendants(proposed, stored.where("deleted").select(*by, id_col), by, id_col, parent)
    keep = stored.where("edited or deleted")
    new = proposed.join(dead, [*by, id_col], "left_anti").join(keep.select(*by, id_col), [*by, id_col], "left_anti")
    return keep.unionByName(new, allowMissingColumns=True)


def latest(versions: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """The row of the highest revision of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(revision))
    return versions.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def resolve_candidates(media: DataFrame, candidates: DataFrame, by: list[str], identity: str, preferred: str, strict: bool = False) -> DataFrame:
    """Which of the documents found for each recording counts: (by, outcome, origin, revision, n_items).

    media: ``identity``; candidates: ``identity``, origin, revision, readable, n_items. Only a readable document of the
    recording's own identity counts; the highest revision wins (null is 0), on equal ones that of the ``preferred`` origin. The outcome
    is ``found``, or ``none`` if nothing counts or the winner holds no item. If ``strict``, a document that can't be read
    makes it ``error``: it may hold what the recording needs. A null identity is nobody's; a null readable is not readable."""
    own = candidates.withColumnRenamed(identity, "__theirs").join(media.select(*by, identity), by)
    readable = F.coalesce("readable", F.lit(False))
    counts = readable & F.coalesce(F.col("__theirs") == F.col(identity), F.lit(False))
    rank = F.struct(F.coalesce("revision", F.lit(0)).cast("long").alias("revision"), (F.col("origin") == preferred).alias("__first"), "origin", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))
    best = own.groupBy(*by).agg(F.max(F.when(counts, rank)).alias("__best"), F.max(~readable).alias("__broken"))
    broken = F.coalesce("__broken", F.lit(False)) & F.lit(strict)
    outcome = F.when(broken, "error").when(F.coalesce("__best.n_items", F.lit(0)) == 0, "none").otherwise("found")
    out = media.select(*by).join(best, by, "left").withColumn("outcome", outcome)
    return out.select(*by, "outcome", *(F.when(F.col("outcome") == "found", F.col(f"__best.{c}")).alias(c) for c in ("origin", "revision", "n_items")))


# ---- edits of single ranges and clips, as column or table transformations


def split_at(df: DataFrame, t, min_len) -> DataFrame:
    """Ranges that hold ``t`` with at least ``min_len`` on both sides become two (part 0 and 1)."""
    t = F.lit(t) if not isinstance(t, Column) else t
    fits = (t - F.col("t_ini") >= F.lit(min_len)) & (F.col("t_fin") - t >= F.lit(min_len))
    two = F.array(F.struct(F.lit(0).alias("part"), F.col("t_ini").alias("a"), t.alias("b")), F.struct(F.lit(1).alias("part"), t.alias("a"), F.col("t_fin").alias("b")))
    one = F.array(F.struct(F.lit(0).alias("part"), F.col("t_ini").alias("a"), F.col("t_fin").alias("b")))
    out = df.withColumn("__p", F.explode(F.when(fits, two).otherwise(one)))
    return out.withColumn("part", F.col("__p.part")).withColumn("t_ini", F.col("__p.a")).withColumn("t_fin", F.col("__p.b")).drop("__p")


def trim_edge(df: DataFrame, edge: str, t, min_len) -> DataFrame:
    """Moves one edge to ``t``, but leaves at least ``min_len``."""
    t = F.lit(t) if not isinstance(t, Column) else t
    if edge == "start":
        return df.withColumn("t_ini", F.greatest(F.lit(0), F.least(t, F.col("t_fin") - F.lit(min_len))))
    return df.withColumn("t_fin", F.greatest(t, F.col("t_ini") + F.lit(min_len)))


def shift_all(df: DataFrame, by: list[str], delta, hi) -> DataFrame:
    """Shifts all ranges of a timeline by one clamped delta, so that none leaves [0, hi]."""
    span = df.groupBy(*by).agg(F.min("t_ini").alias("__lo"), F.max("t_fin").alias("__hi"))
    step = F.greatest(-F.col("__lo"), F.least(F.lit(delta), F.lit(hi) - F.col("__hi")))
    return df.join(span, by).withColumn("t_ini", F.col("t_ini") + step).withColumn("t_fin", F.col("t_fin") + step).drop("__lo", "__hi")


def range_at(df: DataFrame, t) -> DataFrame:
    """Ranges that hold t, ends included."""
    return df.where(meets("t_ini", "t_fin", F.lit(t), F.lit(t), Convention.CLOSED))


def close_gaps(clips: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Moves the clips of a track together: each begins where the one before ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    size = F.col("seq_fin") - F.col("seq_ini")
    start = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return clips.withColumn("__s", start).withColumn("seq_fin", F.col("__s") + size).withColumn("seq_ini", F.col("__s")).drop("__s")


def ripple_delete(clips: DataFrame, by: list[str], doomed: Column) -> DataFrame:
    """Deletes clips and moves later clips of the track left by what was deleted before them."""
    w = Window.partitionBy(*by).orderBy("seq_ini").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.when(doomed, F.col("seq_fin") - F.col("seq_ini")).otherwise(0)).over(w), F.lit(0))
    return clips.withColumn("__g", gone).where(~doomed).withColumn("seq_ini", F.col("seq_ini") - F.col("__g")).withColumn("seq_fin", F.col("seq_fin") - F.col("__g")).drop("__g")


def edge_limits(clips: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """How far each clip's edges may move: to its neighbours, and inside its source."""
    w = Window.partitionBy(*by).orderBy("seq_ini", id_col)
    left = F.greatest(F.coalesce(F.lag("seq_fin").over(w), F.lit(0)) - F.col("seq_ini"), -F.col("source_ini"))
    right = F.coalesce(F.lead("seq_ini").over(w) - F.col("seq_fin"), F.lit(None))
    return clips.select(*by, id_col, left.alias("start_min"), (F.col("seq_fin") - F.col("seq_ini")).alias("start_max"), (F.col("seq_ini") - F.col("seq_fin")).alias("end_min"), right.alias("end_max"))


def overwrite(clips: DataFrame, by: list[str], id_col: str, new: DataFrame) -> DataFrame:
    """Puts ``new`` clips over a track: what they cover is trimmed, split or deleted."""
    from .intervals import difference

    as_time = clips.select(*by, id_col, F.col("seq_ini").alias("t_ini"), F.col("seq_fin").alias("t_fin"), "source_ini")
    cover = new.select(*by, F.col("seq_ini").alias("t_ini"), F.col("seq_fin").alias("t_fin"))
    left = difference(as_time, cover, by, id_col).withColumnsRenamed({"t_ini": "a", "t_fin": "b"})
    kept = left.join(as_time, [*by, id_col]).select(*by, id_col, F.col("a").alias("seq_ini"), F.col("b").alias("seq_fin"), (F.col("source_ini") + F.col("a") - F.col("t_ini")).alias("source_ini"))
    return kept.unionByName(new.select(*by, id_col, "seq_ini", "seq_fin", "source_ini"))


def next_item(items: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """Each item with the one before and after it in its lane."""
    w = Window.partitionBy(*by).orderBy("t_ini", "t_fin", id_col)
    return items.select(*by, id_col, F.lag(id_col).over(w).alias("prev_id"), F.lead(id_col).over(w).alias("next_id"))


def stable_ids(df: DataFrame, by: list[str], prefix: str, order: list, width: int = 4) -> DataFrame:
    """prefix + number from 0 in chronological order of each stream; ties need an explicit order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("stable_id", F.format_string(f"{prefix}%0{width}d", F.row_number().over(w) - 1))


def busiest_lane(items: DataFrame, by: list[str], lane: str, a, b, rank: str) -> DataFrame:
    """The lane with most items in (a, b); ties go to the first lane by ``rank``."""
    hits = items.where(meets("t_ini", "t_fin", F.lit(a), F.lit(b))).groupBy(*by, lane).agg(F.count("*").alias("hits"), F.min(rank).alias("__rank"))
    w = Window.partitionBy(*by).orderBy(F.desc("hits"), "__rank", lane) if by else Window.orderBy(F.desc("hits"), "__rank", lane)
    return hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__rank")


def declared_and_used(declared: DataFrame, used: DataFrame, by: list[str], id_col: str, defaults: dict) -> DataFrame:
    """Declared lanes, and those that only the rows name, with default fields."""
    extra = used.select(*by, id_col).where(F.col(id_col).isNotNull()).distinct().join(declared, [*by, id_col], "left_anti")
    return declared.unionByName(extra.withColumns({c: F.lit(v) for c, v in defaults.items()}), allowMissingColumns=True)


def partition_errors(whole: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Where ``parts`` doesn't split ``whole`` exactly: rows that are missing, and rows that are extra
    or twice."""
    missing = whole.select(*keys).exceptAll(parts.select(*keys)).withColumn("error", F.lit("missing"))
    extra = parts.select(*keys).exceptAll(whole.select(*keys)).withColumn("error", F.lit("extra"))
    return missing.unionByName(extra)


def proposal_findings(clips: DataFrame, by: list[str], clip: str, order: str, targets: DataFrame, tolerance: float, min_clip, max_clip, eps=0, bin_width=None) -> DataFrame:
    """What is to be said of proposed clips (by, clip, order, t_ini, t_fin, reason, repeat): (by, clip, level, kind, other).

    A clip that takes up a range of an earlier one (lower ``order``) again is an error ``repeats``, or a warning ``callback`` if it is
    marked ``repeat`` and gives a reason; ``other`` is the earlier clip. Warnings are ``short`` and ``long`` (a fifth beyond the
    limits), ``no_reason``, and for a whole proposal (clip null) ``off_target``: its length differs from its ``target`` by more than
    that share. A null or zero target, and clips without a time, are said nothing of; a null repeat is no repeat."""
    from .joins import overlap_join

    said = F.trim(F.coalesce("reason", F.lit(""))) != ""
    rows = clips.select(*by, clip, F.col(order).alias("__o"), "t_ini", "t_fin", (said & F.coalesce("repeat", F.lit(False))).alias("__meant"), said.alias("__said"))
    earlier = rows.select(*by, F.col(clip).alias("other"), F.col("__o").alias("__before"), (F.col("t_ini") + F.lit(eps)).alias("r_ini"), (F.col("t_fin") - F.lit(eps)).alias("r_fin"))
    again = overlap_join(rows, earlier, by, bin_width=bin_width).where("__before < __o")
    again = again.select(*by, clip, F.when(F.col("__meant"), "warning").otherwise("error").alias("level"), F.when(F.col("__meant"), "callback").otherwise("repeats").alias("kind"), "other")
    length = F.col("t_fin") - F.col("t_ini")
    kinds = F.array(F.when(length < F.lit(min_clip) * 0.8, "short"), F.when(length > F.lit(max_clip) * 1.2, "long"), F.when(~F.col("__said"), "no_reason"))
    nothing = F.lit(None).cast(clips.schema[clip].dataType)
    alone = rows.select(*by, clip, F.lit("warning").alias("level"), F.explode(F.array_compact(kinds)).alias("kind"), nothing.alias("other"))
    total = rows.groupBy(*by).agg(F.sum(length).alias("__total")).join(targets, by)
    off = total.where((F.col("target") > 0) & (F.abs(F.col("__total") - F.col("target")) > F.col("target") * F.lit(tolerance)))
    return again.unionByName(alone).unionByName(off.select(*by, nothing.alias(clip), F.lit("warning").alias("level"), F.lit("off_target").alias("kind"), nothing.alias("other")))


def outside_parent(items: DataFrame, by: list[str], id_col: str, parent: str) -> DataFrame:
    """Items whose range lies in no range of their parent."""
    kids = items.where(F.col(parent).isNotNull()).select(*by, id_col, F.col(parent).alias("__p"), "t_ini", "t_fin")
    above = items.select(*by, F.col(id_col).alias("__p"), F.col("t_ini").alias("p_ini"), F.col("t_fin").alias("p_fin"))
    held = kids.join(above, [*by, "__p"]).where((F.col("t_ini") >= F.col("p_ini")) & (F.col("t_fin") <= F.col("p_fin")))
    return kids.join(held.select(*by, id_col, "t_ini", "t_fin").distinct(), [*by, id_col, "t_ini", "t_fin"], "left_anti").select(*by, id_col)


def ordered_layers(layers: DataFrame, saved: DataFrame, by: list[str], id_col: str, rank: str) -> DataFrame:
    """Layers in the saved order; new ones after the saved ones, by their default rank."""
    both = layers.join(saved.select(*by, id_col, "pos"), [*by, id_col], "left")
    w = Window.partitionBy(*by).orderBy(F.col("pos").isNull(), "pos", rank, id_col)
    return both.withColumn("place", F.row_number().over(w) - 1).drop("pos")


def snapped_proposal(proposal: DataFrame, hard: DataFrame, soft: DataFrame, by: list[str], id_col: str, radius, eps, reach, least, bin_width=None) -> DataFrame:
    """A proposal with both edges of each cut at the safest place nearby, and the warnings:
    cuts that came out too short, or whose edges still cross something."""
    from .planning import snap

    ends = proposal.select(*by, id_col, F.explode(F.array(F.struct(F.lit("a").alias("e"), F.col("t_ini").alias("t")), F.struct(F.lit("b").alias("e"), F.col("t_fin").alias("t")))).alias("x"))
    targets = ends.select(*by, F.concat(F.col(id_col).cast("string"), F.lit("/"), F.col("x.e")).alias("__edge"), F.col("x.t").alias("target"))
    done = snap(targets, hard, soft, by, "__edge", radius, eps, reach, bin_width)
    name = F.substring_index("__edge", "/", 1)
    first = done.where("endswith(__edge, '/a')").select(*by, name.alias("__id"), F.col("snapped").alias("s_ini"), F.col("n_hard").alias("h_ini"))
    last = done.where("endswith(__edge, '/b')").select(*by, name.alias("__id"), F.col("snapped").alias("s_fin"), F.col("n_hard").alias("h_fin"))
    both = proposal.withColumn("__id", F.col(id_col).cast("string")).join(apart(first), [*by, "__id"]).join(apart(last), [*by, "__id"]).drop("__id")
    notes = F.array_compact(F.array(F.when(F.col("s_fin") - F.col("s_ini") < F.lit(least), F.lit("too_short")), F.when(F.col("h_ini") + F.col("h_fin") > 0, F.lit("crosses")), F.when((F.col("s_ini") != F.col("t_ini")) | (F.col("s_fin") != F.col("t_fin")), F.lit("moved"))))
    return both.withColumn("warnings", F.array_join(notes, ",")).drop("h_ini", "h_fin")
