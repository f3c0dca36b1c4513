"""Remapping of timelines: kept segments to a child clock, and what follows from the cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import Convention
from .joins import asof, overlap_join, stabbing_join


def time_map(segments: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Kept segments in play order with their place on the child clock (child_ini, child_fin)."""
    w = Window.partitionBy(*by).orderBy(*order)
    size = F.col("source_fin") - F.col("source_ini")
    start = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.withColumn("segment", F.row_number().over(w) - 1).withColumn("child_ini", start).withColumn("child_fin", F.col("child_ini") + size)


def map_range(events: DataFrame, mapping: DataFrame, by: list[str], id_col: str, bin_width=None) -> DataFrame:
    """Each common part of an event and a segment, on the child clock, with a derived id."""
    m = mapping.select(*by, "segment", "source_ini", "source_fin", "child_ini")
    hit = overlap_join(events, m, by, ("t_ini", "t_fin"), ("source_ini", "source_fin"), bin_width=bin_width)
    a, b = F.greatest("t_ini", "source_ini"), F.least("t_fin", "source_fin")
    shift = F.col("child_ini") - F.col("source_ini")
    new_id = F.concat(F.col(id_col).cast("string"), F.lit("~s"), (F.col("segment") + 1).cast("string"))
    out = hit.withColumn("child_id", new_id).withColumn("src_ini", a).withColumn("src_fin", b)
    out = out.withColumn("clipped_left", F.col("t_ini") < F.col("source_ini")).withColumn("clipped_right", F.col("t_fin") > F.col("source_fin"))
    return out.withColumn("c_ini", F.col("src_ini") + shift).withColumn("c_fin", F.col("src_fin") + shift).drop("source_ini", "source_fin", "child_ini")


def child_to_source(points: DataFrame, mapping: DataFrame, by: list[str], t: str) -> DataFrame:
    """Source time of each instant of the child clock; null outside."""
    at = asof(points, mapping.select(*by, "child_ini", "child_fin", "source_ini"), by, t, "child_ini", ["child_fin", "source_ini"], prefix="m_")
    inside = F.col(t) < F.col("m_child_fin")
    return at.select(*points.columns, F.when(inside, F.col("m_source_ini") + F.col(t) - F.col("m_t")).alias("source_t"))


def source_to_child(points: DataFrame, mapping: DataFrame, by: list[str], t: str, bin_width=None) -> DataFrame:
    """All child times of each source instant, ends included: one row per segment that plays it."""
    hit = stabbing_join(points, mapping.select(*by, "segment", "source_ini", "source_fin", "child_ini"), by, t, ("source_ini", "source_fin"), Convention.CLOSED, bin_width)
    return hit.select(*points.columns, "segment", (F.col("child_ini") + F.col(t) - F.col("source_ini")).alias("child_t"))


def junctions(mapping: DataFrame, by: list[str]) -> DataFrame:
    """Neighbouring segments: where they join, how far the source jumps, in order or not."""
    w = Window.partitionBy(*by).orderBy("segment")
    nxt = mapping.withColumn("r_segment", F.lead("segment").over(w)).withColumn("r_source_ini", F.lead("source_ini").over(w)).where("r_segment is not null")
    return nxt.select(*by, F.col("segment").alias("left_segment"), "r_segment", F.col("child_fin").alias("join_t"), F.col("source_fin").alias("left_out"), F.col("r_source_ini").alias("right_in"), (F.col("r_source_ini") - F.col("source_fin")).alias("jump"), (F.col("r_source_ini") >= F.col("source_fin")).alias("chronological"))


def edge_quality(edges: DataFrame, words: DataFrame, by: list[str], t: str, text: str, clearance, pause, bin_width=None) -> DataFrame:
    """Classifies cut edges: inside_word, close (less than ``clearance`` from a word), natural (a
    closed sentence, a pause or the edge of the file) or open."""
    from .sequence import ends_sentence

    spans = words.select(*by, F.col("t_ini").alias("w_ini"), F.col("t_fin").alias("w_fin"))
    inside = stabbing_join(edges.select(*by, t).distinct(), spans, by, t, ("w_ini", "w_fin"), Convention.STAB, bin_width).select(*by, t).distinct().withColumn("__in", F.lit(True))
    prev = asof(edges, words, by, t, "t_fin", [text], True, prefix="prev_")
    both = asof(prev, words, by, t, "t_ini", [text], False, prefix="next_")
    both = both.join(inside, [*by, t], "left")
    before, after = F.col(t) - F.col("prev_t"), F.col("next_t") - F.col(t)
    gap = F.col("next_t") - F.col("prev_t")
    kind = (
        F.when(F.col("__in").isNotNull(), "inside_word")
        .when((before < F.lit(clearance)) & (before > 0) | (after < F.lit(clearance)) & (after > 0), "close")
        .when(F.col("prev_t").isNull() | F.col("next_t").isNull() | ends_sentence(F.col(f"prev_{text}")) | (gap >= F.lit(pause)), "natural")
        .otherwise("open")
    )
    return both.withColumn("edge", kind).drop("__in")


def risk_score(cards: DataFrame) -> DataFrame:
    """Additive risk of a junction, 0 to 100, with reasons. Columns: mid_left, mid_right,
    dependent_start, open_clause, same_scene, jump (ms), chronological, teaser_before."""
    far = F.abs("jump")
    parts = [
        (F.col("mid_left"), F.lit(30), "left edge inside a phrase"),
        (F.col("mid_right"), F.lit(30), "right edge inside a phrase"),
        (F.col("dependent_start"), F.lit(15), "begins with a dependent word"),
        (F.col("open_clause"), F.lit(15), "open clause"),
        (~F.col("same_scene"), F.lit(10), "scene changes"),
        (far > 12_000, F.when(far > 300_000, 22).when(far > 60_000, 15).otherwise(8), "source jump"),
        (~F.col("chronological") & ~F.col("teaser_before"), F.lit(25), "not in order"),
    ]
    total = sum((F.when(F.coalesce(c, F.lit(False)), p).otherwise(0) for c, p, _ in parts[1:]), F.when(F.coalesce(parts[0][0], F.lit(False)), parts[0][1]).otherwise(0))
    why = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, _, r in parts]))
    return cards.withColumn("risk", F.least(total, F.lit(100))).withColumn("reasons", F.array_join(why, "; "))


def snap_back(cuts: DataFrame, keyframes: DataFrame, by: list[str], t: str, key_t: str, order: list[str]) -> DataFrame:
    """Moves each inner boundary to the keyframe at or before it, never before the last one."""
    at = asof(cuts, keyframes, by, t, key_t, [], True, prefix="key_")
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("snapped", F.max(F.coalesce("key_t", F.col(t))).over(w)).drop("key_t")


def derive(streams: DataFrame, mapping: DataFrame, by: list[str], id_col: str, bin_width=None) -> DataFrame:
    """All events of all streams on the child clock; events outside the kept segments are gone."""
    return map_range(streams, mapping, by, id_col, bin_width).withColumnsRenamed({"t_ini": "parent_ini", "t_fin": "parent_fin", "c_ini": "t_ini", "c_fin": "t_fin"})


def derive_layer(items: DataFrame, mapping: DataFrame, by: list[str], id_col: str, parent: str) -> DataFrame:
    """Layer items on the child clock; items without a range left, and all below them, are gone."""
    from .documents import descendants

    moved = derive(items, mapping, by, id_col)
    lost = items.join(moved.select(*by, id_col).distinct(), [*by, id_col], "left_anti")
    dead = descendants(items, lost.select(*by, id_col), by, id_col, parent)
    return moved.join(dead, [*by, id_col], "left_anti")
