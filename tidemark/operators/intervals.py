"""Interval algebra on event tables (t_ini, t_fin), any numeric clock.

Which intervals meet is a matter of convention; every operator names its own:

* OPEN: strict overlap, ``a.t_ini < b.t_fin and a.t_fin > b.t_ini``;
* CLOSED: a point on either end is inside;
* STAB: a point on an end is outside;
* HALF_OPEN: ``s < hi and (e > lo or (e = s and s >= lo))``: a zero-length event counts at its
  left edge only.

All operators take ``by``, the columns that separate independent timelines; windows are always
partitioned by them. ``slice_width`` merges within time slices first, so that a timeline
that holds a large share of all rows is reduced in many tasks before one task sees it.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Convention(Enum):
    OPEN = "open"
    CLOSED = "closed"
    STAB = "stab"
    HALF_OPEN = "half_open"


def meets(s, e, lo, hi, convention: Convention = Convention.OPEN) -> Column:
    """Does [s, e] meet [lo, hi] (pass lo twice for a point)?"""
    s, e, lo, hi = (F.col(x) if isinstance(x, str) else x for x in (s, e, lo, hi))
    if convention is Convention.CLOSED:
        return (s <= hi) & (e >= lo)
    if convention is Convention.HALF_OPEN:
        return (s < hi) & ((e > lo) | ((e == s) & (s >= lo)))
    return (s < hi) & (e > lo)


def overlap_length(s, e, lo, hi) -> Column:
    """Length of the common part, never negative."""
    s, e, lo, hi = (F.col(x) if isinstance(x, str) else x for x in (s, e, lo, hi))
    return F.greatest(F.lit(0), F.least(e, hi) - F.greatest(s, lo))


def islands(df: DataFrame, by: list[str], start: str = "t_ini", end: str = "t_fin", gap=0, touching: bool = True, order: list | None = None, name: str = "island") -> DataFrame:
    """Numbers the runs of intervals whose start is within ``gap`` of the running end.

    ``touching``: a start exactly at the running end plus gap joins the run; else it opens a new one."""
    w = Window.partitionBy(*by).orderBy(start, end, *(order or []))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) + F.lit(gap)
    opens = (F.col(start) > reach) if touching else (F.col(start) >= reach)
    return df.withColumn("__opens", F.when(reach.isNull() | opens, 1).otherwise(0)).withColumn(name, F.sum("__opens").over(w)).drop("__opens")


def union(df: DataFrame, by: list[str], start: str = "t_ini", end: str = "t_fin", gap=0, touching: bool = True, slice_width=None) -> DataFrame:
    """Union of the intervals of each timeline: (by, t_ini, t_fin, n_parts); empty ones are dropped."""
    rows = df.where(F.col(end) > F.col(start)).select(*by, F.col(start).alias("t_ini"), F.col(end).alias("t_fin"), F.lit(1).cast("long").alias("n_parts"))
    if slice_width is not None:
        rows = _merge(rows.withColumn("__slice", F.floor(F.col("t_ini") / F.lit(slice_width))), [*by, "__slice"], gap, touching).drop("__slice")
    return _merge(rows, by, gap, touching)


def _merge(rows: DataFrame, by: list[str], gap, touching: bool) -> DataFrame:
    numbered = islands(rows, by, gap=gap, touching=touching)
    return numbered.groupBy(*by, "island").agg(F.min("t_ini").alias("t_ini"), F.max("t_fin").alias("t_fin"), F.sum("n_parts").alias("n_parts")).drop("island")


def complement(merged: DataFrame, by: list[str], bounds: DataFrame, min_gap=0) -> DataFrame:
    """Gaps of merged intervals inside the bounds (by, lo, hi), also before the first and after
    the last: (by, t_ini, t_fin, leading, trailing). A timeline without intervals is one gap."""
    w = Window.partitionBy(*by).orderBy("t_ini", "t_fin")
    edges = merged.select(*by, "t_ini", "t_fin").unionByName(bounds.select(*by, F.col("hi").alias("t_ini"), F.lit(None).cast(merged.schema["t_fin"].dataType).alias("t_fin")))
    reach = F.max("t_fin").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = edges.withColumn("__reach", reach).withColumn("trailing", F.col("t_fin").isNull()).join(bounds, by)
    gaps = cut.select(*by, F.greatest(F.coalesce("__reach", "lo"), "lo").alias("t_ini"), F.least("t_ini", "hi").alias("t_fin"), (F.coalesce("__reach", "lo") <= F.col("lo")).alias("leading"), "trailing")
    return gaps.where((F.col("t_fin") > F.col("t_ini")) & (F.col("t_fin") - F.col("t_ini") >= F.lit(min_gap)))


def difference(left: DataFrame, right: DataFrame, by: list[str], id_col: str, min_keep=0, bin_width=None) -> DataFrame:
    """What is left of each interval of ``left`` after the union of ``right`` is taken out:
    (by, id, t_ini, t_fin). Remainders shorter than ``min_keep`` are dropped."""
    from .joins import overlap_join

    cover = union(right, by).select(*by, F.col("t_ini").alias("c_ini"), F.col("t_fin").alias("c_fin"))
    some = left.where("t_fin > t_ini").select(*by, id_col, "t_ini", "t_fin")
    hit = overlap_join(some, cover, by, ("t_ini", "t_fin"), ("c_ini", "c_fin"), bin_width=bin_width)
    w = Window.partitionBy(*by, id_col).orderBy("c_ini")
    cuts = hit.select(*by, id_col, "t_ini", "t_fin", "c_ini", "c_fin")
    before = cuts.select(*by, id_col, F.greatest("t_ini", F.coalesce(F.lag("c_fin").over(w), "t_ini")).alias("a"), F.least("c_ini", "t_fin").alias("b"))
    last = cuts.groupBy(*by, id_col).agg(F.max("c_fin").alias("a"), F.max("t_fin").alias("b"))
    whole = some.join(cuts.select(*by, id_col).distinct(), [*by, id_col], "left_anti").select(*by, id_col, F.col("t_ini").alias("a"), F.col("t_fin").alias("b"))
    parts = before.unionByName(last).unionByName(whole).where(F.col("b") > F.col("a"))
    return parts.where(F.col("b") - F.col("a") >= F.lit(min_keep)).select(*by, id_col, F.col("a").alias("t_ini"), F.col("b").alias("t_fin"))


def kept_segments(cuts: DataFrame, by: list[str], bounds: DataFrame, min_keep) -> DataFrame:
    """What is left of the bounds after the union of the cuts; shorter remainders are dropped."""
    inner = union(cuts, by).join(bounds, by).where("t_ini < hi and t_fin > lo").select(*by, "t_ini", "t_fin")
    return complement(inner, by, bounds, min_keep).select(*by, "t_ini", "t_fin")


def covered(merged: DataFrame, by: list[str], bounds: DataFrame) -> DataFrame:
    """Measure of merged intervals inside the bounds: (by, covered, hi - lo)."""
    inside = bounds.join(merged.select(*by, "t_ini", "t_fin"), by, "left")
    part = F.coalesce(overlap_length("t_ini", "t_fin", "lo", "hi"), F.lit(0))
    return inside.groupBy(*by).agg(F.sum(part).alias("covered"), (F.max("hi") - F.max("lo")).alias("span"))


def elementary(df: DataFrame, by: list[str], start: str = "t_ini", end: str = "t_fin") -> DataFrame:
    """The pieces between neighbouring distinct edges of a timeline: (by, a, b)."""
    edges = df.select(*by, F.explode(F.array(start, end)).alias("a"))
    w = Window.partitionBy(*by).orderBy("a")
    # of equal edges only the last has another one behind it
    return edges.withColumn("b", F.lead("a").over(w)).where("b is not null and (a is null or b > a)")


def flatten(clips: DataFrame, by: list[str], rank: str, clip: str = "clip_id", gaps: bool = False, bin_width=None) -> DataFrame:
    """In each instant the clip of the highest rank wins (ties: the smaller clip id); neighbouring
    pieces of one clip are joined. Clips carry seq_ini, seq_fin and source_ini. Without ``gaps``
    the pieces are moved together: (by, pos, clip, seq_ini, seq_fin, source_ini, source_fin)."""
    from .joins import overlap_join

    clips = clips.where("seq_fin > seq_ini")
    pieces = elementary(clips, by, "seq_ini", "seq_fin")
    # no clip begins or ends inside a piece, so those over it are those over its left edge, which lies in one cell of a level
    clips = clips.select(*by, clip, rank, "seq_ini", "seq_fin", "source_ini")
    over = overlap_join(pieces, clips, by, ("a", "a"), ("seq_ini", "seq_fin"), Convention.CLOSED, bin_width).where("seq_fin > a")
    first = Window.partitionBy(*by, "a").orderBy(F.desc(rank), clip)
    top = over.withColumn("__r", F.row_number().over(first)).where("__r = 1")
    top = top.select(*by, clip, "a", "b", (F.col("source_ini") + F.col("a") - F.col("seq_ini")).alias("s"))
    line = Window.partitionBy(*by).orderBy("a")
    joined = (F.lag(clip).over(line) == F.col(clip)) & (F.lag("b").over(line) == F.col("a"))
    runs = top.withColumn("__n", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("__n").over(line))
    out = runs.groupBy(*by, "run", clip).agg(F.min("a").alias("seq_ini"), F.max("b").alias("seq_fin"), F.min("s").alias("source_ini"))
    out = out.withColumn("source_fin", F.col("source_ini") + F.col("seq_fin") - F.col("seq_ini"))
    order = Window.partitionBy(*by).orderBy("run")
    out = out.withColumn("pos", F.row_number().over(order) - 1)
    if not gaps:
        before = F.coalesce(F.sum(F.col("source_fin") - F.col("source_ini")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn("seq_ini", before).withColumn("seq_fin", F.col("seq_ini") + F.col("source_fin") - F.col("source_ini"))
    return out.select(*by, "pos", clip, "seq_ini", "seq_fin", "source_ini", "source_fin")


def add_range(parts: DataFrame, by: list[str], a, b, min_len=0) -> DataFrame:
    """Adds [a, b] to each timeline: it grows over all parts that it strictly overlaps."""
    a, b = F.lit(a), F.lit(b)
    hit = meets("t_ini", "t_fin", a, b)
    grown = parts.groupBy(*by).agg(F.least(a, F.min(F.when(hit, F.col("t_ini")))).alias("t_ini"), F.greatest(b, F.max(F.when(hit, F.col("t_fin")))).alias("t_fin"))
    if min_len:
        grown = grown.where(b - a >= F.lit(min_len))
    return parts.select(*by, "t_ini", "t_fin").where(~hit).unionByName(grown)


def subtract_range(parts: DataFrame, by: list[str], a, b, min_len=0) -> DataFrame:
    """Takes [a, b] out of each part: a part is kept, trimmed, split in two, or gone."""
    a, b = F.lit(a), F.lit(b)
    left = F.struct(F.col("t_ini").alias("t_ini"), F.least("t_fin", a).alias("t_fin"))
    right = F.struct(F.greatest("t_ini", b).alias("t_ini"), F.col("t_fin").alias("t_fin"))
    hit = meets("t_ini", "t_fin", a, b)
    pieces = F.when(hit, F.array(left, right)).otherwise(F.array(F.struct("t_ini", "t_fin")))
    cut = parts.select(*by, hit.alias("__hit"), F.explode(pieces).alias("p")).select(*by, "__hit", "p.t_ini", "p.t_fin")
    return cut.where(~F.col("__hit") | (F.col("t_fin") - F.col("t_ini") >= F.greatest(F.lit(min_len), F.lit(1e-9)))).drop("__hit")


def edges(df: DataFrame, by: list[str], start: str = "t_ini", end: str = "t_fin") -> DataFrame:
    """Distinct edges of all intervals: (by, t)."""
    return df.select(*by, F.explode(F.array(start, end)).alias("t")).distinct()


def shielded(pieces: DataFrame, words: DataFrame, by: list[str], id_col: str, shrink, min_keep, bin_width=None) -> DataFrame:
    """What is left of each piece outside the words, shrunk on both sides; a piece that keeps
    nothing is one row without times."""
    inner = words.select(*by, (F.col("t_ini") + F.lit(shrink)).alias("t_ini"), (F.col("t_fin") - F.lit(shrink)).alias("t_fin")).where("t_fin > t_ini")
    left = difference(pieces, inner, by, id_col, min_keep, bin_width)
    return pieces.where("t_fin > t_ini").select(*by, id_col).join(left, [*by, id_col], "left")


def speech_from_activity(active: DataFrame, words: DataFrame, by: list[str], merge, bin_width=None) -> DataFrame:
    """Voice activity that meets a word, and words that no activity meets, as merged regions."""
    from .joins import overlap_join

    heard = overlap_join(active.select(*by, "t_ini", "t_fin"), words.select(*by, F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin")), by, bin_width=bin_width, how="left_semi")
    missed = overlap_join(words.select(*by, "t_ini", "t_fin"), active.select(*by, F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin")), by, bin_width=bin_width, how="left_anti")
    return union(heard.unionByName(missed), by, gap=merge).drop("n_parts")
