"""Sequence operators: pauses, sessions, runs, hysteresis, smoothing, peaks, spans.

What a window can say is a window. The few operators whose next step depends on the step
before (greedy separation, prominence, wake spans) run per timeline in
``applyInPandas``: a timeline is one recording, which fits a task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored
from .intervals import Convention, complement, islands, union
from .stats import zscore

CLOSERS = "\"')]»”’"
SENTENCE_ENDS = ".!?…"


def ends_sentence(word):
    """Does a word end a sentence, behind closing quotes?"""
    return F.rtrim(F.translate(F.rtrim(word), CLOSERS, "")).rlike(r"[.!?…]$")


def pauses(words: DataFrame, by: list[str], text: str, min_dur, start: str = "t_ini", end: str = "t_fin", order: list | None = None) -> DataFrame:
    """Gaps of at least ``min_dur`` between a word and all words before it, with neighbours.

    The word before is the one that reaches furthest, not the previous row. The air before the
    first word counts, that after the last doesn't. z is relative to the timeline's own pauses."""
    w = Window.partitionBy(*by).orderBy(start, end, *(order or []))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ordered = words.withColumn("__n", F.row_number().over(w))
    reach = F.max(F.struct(F.col(end).alias("end"), (-F.col("__n")).alias("n"), F.col(text).alias("text"))).over(before)
    cut = ordered.withColumn("__p", reach)
    since = F.coalesce(F.col("__p.end"), F.lit(0))
    gaps = cut.select(*by, since.alias("g_ini"), F.col(start).alias("g_fin"), (F.col(start) - since).alias("dur"), F.col("__p.text").alias("prev_text"), F.col(text).alias("next_text"))
    gaps = gaps.where(F.col("dur") >= F.lit(min_dur)).withColumn("ends_sentence", F.coalesce(ends_sentence(F.col("prev_text")), F.lit(False)))
    return zscore(gaps, by, "dur")


def sessions(df: DataFrame, by: list[str], t: str, gap, order: list | None = None, inclusive: bool = True) -> DataFrame:
    """Numbers runs of points with steps of at most ``gap`` (exclusive: less than ``gap``)."""
    w = Window.partitionBy(*by).orderBy(t, *(order or []))
    step = F.col(t) - F.lag(t).over(w)
    breaks = (step > F.lit(gap)) if inclusive else (step >= F.lit(gap))
    return df.withColumn("__b", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn("session", F.sum("__b").over(w)).drop("__b")


def speech_regions(words: DataFrame, by: list[str], gap, pad, limit=None) -> DataFrame:
    """Words with gaps of at most ``gap`` make a region; regions are padded, clamped, re-merged."""
    merged = union(words, by, gap=gap)
    hi = F.col("t_fin") + F.lit(pad) if limit is None else F.least(F.col("t_fin") + F.lit(pad), F.lit(limit))
    padded = merged.select(*by, F.greatest(F.lit(0), F.col("t_ini") - F.lit(pad)).alias("t_ini"), hi.alias("t_fin"))
    return union(padded, by).drop("n_parts")


def hop_windows(regions: DataFrame, by: list[str], hop, size=None) -> DataFrame:
    """Distinct starts of hopping windows that cover the regions."""
    first, last = F.floor(F.col("t_ini") / hop), F.ceil(F.col("t_fin") / hop) - 1
    out = regions.select(*by, F.explode(F.sequence(first, F.greatest(first, last))).alias("k")).distinct()
    out = out.withColumn("w_ini", F.col("k") * F.lit(hop))
    return out if size is None else out.withColumn("w_fin", F.col("w_ini") + F.lit(size))


def split_long(spans: DataFrame, by: list[str], max_len, overlap) -> DataFrame:
    """Cuts spans into windows of at most ``max_len`` that overlap inside a span only."""
    step = max_len - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("t_fin") - F.col("t_ini") - F.lit(overlap)) / step).cast("long") - 1))
    out = spans.where("t_fin > t_ini").select("*", F.explode(starts).alias("part"))
    return out.withColumn("p_ini", F.col("t_ini") + F.col("part") * step).withColumn("p_fin", F.least(F.col("p_ini") + max_len, F.col("t_fin")))


def repeat_filter(df: DataFrame, by: list[str], t: str, text: str, confidence: str, min_confidence: float, max_repeats: int, order: list | None = None) -> DataFrame:
    """Drops rows of low confidence, and rows after ``max_repeats`` equal texts in a row. The
    count of repeats goes on over rows that the confidence drops."""
    w = Window.partitionBy(*by).orderBy(t, *(order or []))
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    new = ~F.coalesce((body == F.lag(body).over(w)) & (body != ""), F.lit(False))
    runs = df.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(w))
    nth = F.row_number().over(Window.partitionBy(*by, "__run").orderBy(t, *(order or [])))
    kept = runs.withColumn("repeat_no", nth).where((F.col("repeat_no") <= max_repeats) & (body != "") & (F.coalesce(F.col(confidence), F.lit(0.0)) >= min_confidence))
    return kept.drop("__new", "__run")


def runs(df: DataFrame, by: list[str], t: str, label: str, max_step=None, order: list | None = None) -> DataFrame:
    """Runs of equal labels, also cut where the source has a hole: (by, run, label, t_ini, t_fin, n)."""
    w = Window.partitionBy(*by).orderBy(t, *(order or []))
    new = ~F.lag(label).over(w).eqNullSafe(F.col(label))
    if max_step is not None:
        new = new | (F.col(t) - F.lag(t).over(w) > F.lit(max_step))
    marked = df.withColumn("__new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("__new").over(w))
    return marked.groupBy(*by, "run").agg(F.first(label).alias(label), F.min(t).alias("t_ini"), F.max(t).alias("t_fin"), F.count("*").alias("n"))


def label_spans(df: DataFrame, by: list[str], t: str, label: str, max_step, merge, min_dur, order: list | None = None) -> DataFrame:
    """Runs of a label joined over interruptions of at most ``merge`` and of at least ``min_dur``."""
    single = runs(df, by, t, label, max_step, order)
    joined = islands(single, [*by, label], gap=merge).groupBy(*by, label, "island").agg(F.min("t_ini").alias("t_ini"), F.max("t_fin").alias("t_fin"))
    return joined.where(F.col("t_fin") - F.col("t_ini") >= F.lit(min_dur)).drop("island")


def stitch_chunks(frames: DataFrame, by: list[str], chunk: str, frame: str, score: str, threshold: float, min_frames: int, frame_len, slice_width=None) -> DataFrame:
    """Events of scores that were computed in overlapping chunks: (by, t_ini, t_fin, n_parts).

    ``chunk`` is a chunk's start on the clock, ``frame`` a frame's number inside it. Runs of more than ``min_frames`` frames above the
    threshold, from the first frame to the last, are found chunk by chunk, so a long recording is many small windows; what two
    chunks found in their overlap is joined where it meets. Null scores and frames are below; a repeated frame counts once."""
    from .intervals import union

    w = Window.partitionBy(*by, chunk).orderBy(frame)
    above = frames.where((F.col(score) > F.lit(threshold)) & F.col(frame).isNotNull()).select(*by, chunk, frame).distinct()
    numbered = above.withColumn("__run", F.col(frame) - F.row_number().over(w))
    found = numbered.groupBy(*by, chunk, "__run").agg(F.min(frame).alias("__a"), F.max(frame).alias("__b"), F.count("*").alias("__n")).where(F.col("__n") > min_frames)
    spans = found.select(*by, (F.col(chunk) + F.col("__a") * F.lit(frame_len)).alias("t_ini"), (F.col(chunk) + F.col("__b") * F.lit(frame_len)).alias("t_fin"))
    return union(spans, by, touching=True, slice_width=slice_width)


def hysteresis(df: DataFrame, by: list[str], t: str, z: str, value: str, on: float, off: float, abs_min: float, max_step, merge, min_dur) -> DataFrame:
    """Regions that begin at the first sample with z >= on and value >= abs_min and run while
    z > off without a hole in the source; near regions are joined unless the first ended in a
    hole. (by, t_ini, t_fin, t_peak, z_max, value_max, n)."""
    w = Window.partitionBy(*by).orderBy(t)
    go = F.coalesce(F.col(z) > F.lit(off), F.lit(False))
    hole = F.coalesce(F.col(t) - F.lag(t).over(w) > F.lit(max_step), F.lit(False)) | F.lag(z).over(w).isNull()
    marked = df.withColumn("__go", go).withColumn("__new", (~F.coalesce(F.lag(go).over(w), F.lit(False)) | hole).cast("int"))
    marked = marked.withColumn("__run", F.sum("__new").over(w)).withColumn("__next", F.lead(t).over(w)).withColumn("__next_z", F.lead(z).over(w))
    live = marked.where("__go")
    trigger = (F.col(z) >= F.lit(on)) & (F.col(value) >= F.lit(abs_min))
    run = Window.partitionBy(*by, "__run")
    live = live.withColumn("__from", F.min(F.when(trigger, F.col(t))).over(run)).where(F.col(t) >= F.col("__from"))
    ends_in_hole = F.max(F.struct(F.col(t), (F.col("__next").isNotNull() & (F.col("__next_z").isNull() | (F.col("__next") - F.col(t) > F.lit(max_step)))).alias("hole")))
    reg = live.groupBy(*by, "__run").agg(F.min(t).alias("t_ini"), F.max(t).alias("t_fin"), F.max(F.struct(F.col(z).alias("z"), (-F.col(t)).alias("t"))).alias("top"), F.max(value).alias("value_max"), F.count("*").alias("n"), ends_in_hole["hole"].alias("hole"))
    line = Window.partitionBy(*by).orderBy("t_ini")
    apart = F.coalesce(F.lag("hole").over(line) | (F.col("t_ini") - F.lag("t_fin").over(line) > F.lit(merge)), F.lit(True))
    reg = reg.withColumn("__g", apart.cast("int")).withColumn("region", F.sum("__g").over(line))
    out = reg.groupBy(*by, "region").agg(F.min("t_ini").alias("t_ini"), F.max("t_fin").alias("t_fin"), F.max("top").alias("top"), F.max("value_max").alias("value_max"), F.sum("n").alias("n"))
    out = out.where(F.col("t_fin") - F.col("t_ini") >= F.lit(min_dur))
    return out.select(*by, "t_ini", "t_fin", (-F.col("top.t")).alias("t_peak"), F.col("top.z").alias("z_max"), "value_max", "n")


def episodes(df: DataFrame, by: list[str], gap, t_peak: str, label: str, z: str) -> DataFrame:
    """Events within ``gap`` of the running end make an episode with its ordered apexes."""
    numbered = islands(df, by, gap=gap, order=[t_peak, label])
    apex = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(t_peak, label))), lambda x: x[label]), ">")
    return numbered.groupBy(*by, "island").agg(F.min("t_ini").alias("t_ini"), F.max("t_fin").alias("t_fin"), F.max(z).alias("z_max"), F.count("*").alias("n"), apex.alias("apexes")).drop("island")


def peak_clusters(pool: DataFrame, by: list[str], t: str, gap, kind: str, order: list | None = None) -> DataFrame:
    """Peaks with steps of at most ``gap``: (by, session, t_first, t_last, n, kinds, multi)."""
    s = sessions(pool, by, t, gap, order)
    out = s.groupBy(*by, "session").agg(F.min(t).alias("t_first"), F.max(t).alias("t_last"), F.count("*").alias("n"), F.count_distinct(kind).alias("kinds"))
    return out.withColumn("multi", F.col("kinds") >= 2)


def derivative(df: DataFrame, by: list[str], t: str, value: str, max_step, name: str = "speed") -> DataFrame:
    """|dx/dt| between valid neighbours, null across holes."""
    w = Window.partitionBy(*by).orderBy(t)
    dt = F.col(t) - F.lag(t).over(w)
    return df.withColumn(name, F.when((dt > 0) & (dt <= F.lit(max_step)), F.abs(F.col(value) - F.lag(value).over(w)) / dt))


def median_smooth(df: DataFrame, by: list[str], t: str, value: str, half: int, name: str = "smooth") -> DataFrame:
    """Median over ``half`` rows on each side, nulls ignored; a null stays null."""
    w = Window.partitionBy(*by).orderBy(t).rowsBetween(-half, half)
    near = F.array_sort(F.collect_list(value).over(w))  # at most 2 * half + 1 values
    n = F.size(near)
    middle = (F.get(near, F.floor((n - 1) / 2).cast("int")) + F.get(near, F.floor(n / 2).cast("int"))) / 2
    return df.withColumn(name, F.when(F.col(value).isNotNull(), middle))


def bridge_holes(df: DataFrame, by: list[str], t: str, value: str, longest: int, name: str = "bridged") -> DataFrame:
    """Linear interpolation over runs of at most ``longest`` nulls with values on both sides."""
    w = Window.partitionBy(*by).orderBy(t)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    prev = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first(point, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    marked = df.withColumn("__p", prev).withColumn("__f", following).withColumn("__k", F.count(value).over(w))
    hole = F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)).over(Window.partitionBy(*by, "__k"))
    line = F.col("__p.v") + (F.col("__f.v") - F.col("__p.v")) * (F.col(t) - F.col("__p.t")) / (F.col("__f.t") - F.col("__p.t"))
    ok = F.col("__p").isNotNull() & F.col("__f").isNotNull() & (F.col("__hole") <= longest)
    return marked.withColumn("__hole", hole).withColumn(name, F.coalesce(F.col(value), F.when(ok, line))).drop("__p", "__f", "__k", "__hole")


def interpolate_words(words: DataFrame, by: list[str], pos: str, start: str = "t_ini", end: str = "t_fin") -> DataFrame:
    """Times of words that could not be aligned, spread evenly between their aligned neighbours."""
    w = Window.partitionBy(*by).orderBy(pos)
    known = F.when(F.col(start).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(start).alias("s"), F.col(end).alias("e")))
    prev = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    m = words.withColumn("__p", prev).withColumn("__f", following)
    lo = F.coalesce(F.col("__p.e"), F.lit(0.0))
    hi = F.coalesce(F.col("__f.s"), lo)
    n = F.coalesce(F.col("__f.p"), F.col(pos) + 1) - F.coalesce(F.col("__p.p"), F.col(pos) - 1) - 1
    k = F.col(pos) - F.coalesce(F.col("__p.p"), F.col(pos) - 1) - 1
    part = (F.greatest(hi, lo) - lo) / n
    return m.withColumn("aligned", F.col(start).isNotNull()).withColumn("s", F.coalesce(F.col(start), lo + part * k)).withColumn("e", F.coalesce(F.col(end), lo + part * (k + 1))).drop("__p", "__f")


def novelty(df: DataFrame, by: list[str], t: str, value: str, width: int, name: str = "novelty") -> DataFrame:
    """|mean of the ``width`` rows before - mean of the ``width`` rows from here on|."""
    w = Window.partitionBy(*by).orderBy(t)
    return df.withColumn(name, F.abs(F.avg(value).over(w.rowsBetween(-width, -1)) - F.avg(value).over(w.rowsBetween(0, width - 1))))


def local_peaks(df: DataFrame, by: list[str], t: str, value: str, least=None) -> DataFrame:
    """Rows above the row before and not below the row after."""
    w = Window.partitionBy(*by).orderBy(t)
    top = (F.col(value) > F.coalesce(F.lag(value).over(w), F.lit(float("-inf")))) & (F.col(value) >= F.coalesce(F.lead(value).over(w), F.lit(float("-inf"))))
    out = df.withColumn("__top", top).where("__top").drop("__top")
    return out if least is None else out.where(F.col(value) >= F.lit(least))


def _per_timeline(df: DataFrame, by: list[str], columns: list[str], run, schema: str) -> DataFrame:
    """Runs ``run`` on each timeline, its columns in order; keeps the ``by`` columns."""
    types = dict(df.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    names = [c.split()[0] for c in schema.split(", ")]

    def apply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pd.DataFrame(run(pdf.sort_values(columns, kind="stable")), columns=names)
        for i, c in enumerate(by):
            rows.insert(i, c, key[i])
        return rows

    return df.groupBy(*by).applyInPandas(apply, f"{keys}, {schema}")


def separated_peaks(df: DataFrame, by: list[str], t: str, value: str, min_gap, least: float) -> DataFrame:
    """Greedy: the highest peaks first, each at least ``min_gap`` from those taken: (by, peak_t, peak).
    Chosen by rounds, on all timelines at once; peaks within the gap of each other meet in bins of its width."""
    from .greedy import ranked, refused
    from .joins import overlap_join

    peaks = local_peaks(df, by, t, value, least).select(*by, F.col(t).alias("peak_t"), F.col(value).cast("double").alias("peak"))
    peaks = stored(ranked(peaks, by, [F.desc("peak"), "peak_t"]), "peaks")
    near = peaks.select(*by, F.col("rank_no").alias("a"), F.col("peak_t").alias("l_ini"), (F.col("peak_t") + F.lit(min_gap)).alias("l_fin"))
    others = peaks.select(*by, F.col("rank_no").alias("b"), F.col("peak_t").alias("r_ini"), F.col("peak_t").alias("r_fin"))
    close = overlap_join(near, others, by, ("l_ini", "l_fin"), convention=Convention.CLOSED, bin_width=min_gap).where((F.col("r_ini") < F.col("l_fin")) & (F.col("a") != F.col("b")))
    return peaks.join(refused(close, by, "a", "b"), [*by, "rank_no"], "left_anti").select(*by, "peak_t", "peak")


def prominent_peaks(df: DataFrame, by: list[str], t: str, value: str, prominence: float) -> DataFrame:
    """Local maxima that rise at least ``prominence`` above the higher of the two valleys next to them.

    A valley is the lowest value between the peak and the nearest higher row (or the end of the timeline)."""

    def valleys(x: list[float]) -> list[float]:
        out, higher = [], []  # higher: rows that nothing since has passed, each with the lowest value down to the one below
        for v in x:
            low = v
            while higher and higher[-1][0] <= v:
                low = min(low, higher.pop()[1])
            higher.append((v, low))
            out.append(low)
        return out

    def run(pdf):
        x, ts = pdf[value].astype(float).tolist(), pdf[t].tolist()
        left, right = valleys(x), valleys(x[::-1])[::-1]
        tops = (i for i in range(1, len(x) - 1) if x[i] > x[i - 1] and x[i] >= x[i + 1])
        return [(ts[i], x[i], x[i] - max(left[i], right[i])) for i in tops if x[i] - max(left[i], right[i]) >= prominence]

    return _per_timeline(df.where(F.col(value).isNotNull()).select(*by, t, value), by, [t], run, f"peak_t {dict(df.dtypes)[t]}, peak double, prominence double")


def absences(df: DataFrame, by: list[str], t: str, present: str, debounce) -> DataFrame:
    """Absences after short runs are absorbed by the state before: (by, t_ini, t_fin, at_end)."""
    line = Window.partitionBy(*by).orderBy("run")
    stays = (F.col("run") == 1) | (F.col("t_fin") - F.col("t_ini") >= F.lit(debounce))
    held = runs(df, by, t, present).withColumn("__state", F.last(F.when(stays, F.struct(present)), True).over(line)[present])
    new = ~F.col("__state").eqNullSafe(F.lag("__state").over(line)) | (F.row_number().over(line) == 1)
    spans = held.withColumn("__new", new.cast("int")).withColumn("__span", F.sum("__new").over(line)).groupBy(*by, "__span")
    out = spans.agg(F.first("__state").alias("__state"), F.min("t_ini").alias("t_ini"), F.max("t_fin").alias("t_fin"))
    out = out.withColumn("at_end", F.col("__span") == F.max("__span").over(Window.partitionBy(*by)))
    return out.where(~F.coalesce("__state", F.lit(False))).select(*by, "t_ini", "t_fin", "at_end")


def merge_pairwise(df: DataFrame, by: list[str], max_gap, min_dur, peak: str, mean: str) -> DataFrame:
    """Joins events closer than ``max_gap`` to the one before, then drops short ones. A mean is
    halved with that of the next event each time: the first two weigh 2^(1-n), the last a half."""
    w = Window.partitionBy(*by).orderBy("t_ini", "t_fin", peak, mean)
    apart = F.coalesce(F.col("t_ini") - F.lag("t_fin").over(w) >= F.lit(max_gap), F.lit(True))
    rows = df.withColumn("__n", F.row_number().over(w)).withColumn("__new", apart.cast("int")).withColumn("__g", F.sum("__new").over(w))
    group = Window.partitionBy(*by, "__g")
    rows = rows.withColumn("__first", F.min("__n").over(group)).withColumn("__later", F.max("__n").over(group) - F.col("__n"))
    weight = F.pow(F.lit(0.5), F.col("__later") + F.when(F.col("__n") == F.col("__first"), 0).otherwise(1))
    out = rows.groupBy(*by, "__g").agg(F.min("t_ini").alias("t_ini"), F.max_by("t_fin", "__n").alias("t_fin"), F.max(peak).cast("double").alias("peak"), F.sum(F.col(mean) * weight).alias("mean"))
    return out.where(F.col("t_fin") - F.col("t_ini") >= F.lit(min_dur)).drop("__g")


def wake_spans(words: DataFrame, by: list[str], text: str, variants: set[str], end_gap, max_dur, repeat, context: int = 5, slice_width=None) -> DataFrame:
    """Spans opened by a wake word: they end at a gap of ``end_gap``, at ``max_dur``, at a new
    invocation later than ``repeat``, or with the words; invocations inside a span are absorbed:
    (by, t_ini, t_fin, cause, pause, before, heard).

    The span that each wake word would open lies within the words of the next ``max_dur`` and the
    one after; the spans that exist are found by following each to the first wake word after it. The end of a word before its
    start counts as the start; a null word is no wake word and is heard as nothing; words without a time take no part."""
    from .joins import asof, overlap_join
    from .scan import follow, running

    kind = dict(words.dtypes)["t_ini"]
    said = F.trim(F.lower(F.col(text))).isin(*sorted(variants))
    rows = words.where("t_ini IS NOT NULL").select(*by, F.col("t_ini").alias("a"), F.greatest("t_ini", "t_fin").alias("b"), F.col(text).alias("word"), F.coalesce(said, F.lit(False)).alias("wake"))
    order = ["a", "b", "word"]
    rows = running(rows, by, order, {"n": ("count", F.lit(1))}, slice_width)
    rows = stored(rows, "wake")
    opened = rows.where("wake").select(*by, F.col("n").alias("i"), F.col("a").alias("a0"), F.col("b").alias("b0"), (F.col("a") + F.lit(max_dur)).alias("a1"))
    inside = overlap_join(opened, rows.select(*by, F.col("n").alias("k"), F.col("a").alias("r_ini"), F.col("a").alias("r_fin"), F.col("b").alias("r_b"), "word", F.col("wake").alias("again")), by, ("a0", "a1"), convention=Convention.CLOSED, bin_width=slice_width).where("k > i")
    after = asof(opened, rows.select(*by, "a", F.col("n").alias("k"), F.col("b").alias("r_b"), "word", F.col("wake").alias("again")), by, "a1", "a", ["k", "r_b", "word", "again"], False, False, prefix="x_", slice_width=slice_width)
    after = after.where("x_k IS NOT NULL").select(*opened.columns, F.col("x_k").alias("k"), F.col("x_t").alias("r_ini"), F.col("x_r_b").alias("r_b"), F.col("x_word").alias("word"), F.col("x_again").alias("again"))
    pairs = inside.drop("r_fin").unionByName(after)

    span = Window.partitionBy(*by, "i").orderBy("k")
    pairs = pairs.withColumn("reach", F.greatest("b0", F.max("r_b").over(span.rowsBetween(Window.unboundedPreceding, -1))))
    cause = F.when(F.col("r_ini") - F.col("reach") >= F.lit(end_gap), "silence").when(F.col("again") & (F.col("r_ini") - F.col("a0") > F.lit(repeat)), "invocation").when(F.col("r_b") - F.col("a0") > F.lit(max_dur), "limit")
    pairs = pairs.withColumn("cause", cause).withColumn("over", F.count("cause").over(span))
    ended = F.struct("reach", "cause", F.col("r_ini").alias("at"))
    held = F.array_sort(F.collect_list(F.when((F.col("over") == 0) & F.col("word").isNotNull(), F.struct("k", "word"))))
    spans = pairs.where("over = 0 OR (over = 1 AND cause IS NOT NULL)").groupBy(*by, "i").agg(F.max(F.when(F.col("over") == 0, F.col("r_b"))).alias("far"), F.max(F.when(F.col("over") == 1, ended)).alias("ended"), F.array_join(F.transform(held, lambda x: x["word"]), " ").alias("heard"))
    spans = opened.join(spans, [*by, "i"], "left")
    reach = F.coalesce(F.greatest("b0", "far"), F.col("b0"))
    fin = F.when(F.col("ended.cause") == "invocation", F.least(reach, F.col("ended.at"))).otherwise(reach)
    limit = F.col("a0") + F.lit(max_dur)
    spans = spans.select(*by, "i", "a0", F.least(fin, limit).cast(kind).alias("t_fin"), F.when(fin > limit, "limit").otherwise(F.coalesce("ended.cause", F.lit("end"))).alias("cause"), F.coalesce("heard", F.lit("")).alias("heard"))
    spans = stored(spans, "wake")

    # the first wake word at or after the end; an empty span is followed by the next wake word
    further = asof(spans.withColumn("least", F.col("i") + 1), opened.select(*by, "i"), by, "least", "i", [], False, prefix="next_", slice_width=None if slice_width is None else 65_536)
    further = asof(further, opened.select(*by, "a0", F.col("i").alias("w")), by, "t_fin", "a0", ["w"], False, prefix="at_", slice_width=slice_width)
    steps = further.select(*by, F.col("i").alias("at"), F.greatest("next_t", "at_w").alias("to")).where("next_t IS NOT NULL AND at_w IS NOT NULL")
    first = opened.groupBy(*by).agg(F.min("i").alias("at"))
    used = follow(steps, first, by).withColumnRenamed("at", "i")

    around = rows.select(*by, "n", "b", "word", F.explode(F.sequence(F.lit(1), F.lit(context))).alias("back")).select(*by, (F.col("n") + F.col("back")).alias("i"), "n", "b", "word")
    around = around.join(used, [*by, "i"]).groupBy(*by, "i").agg(F.max_by("b", "n").alias("p"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("n", "word")))), lambda x: x["word"]), " ").alias("before"))
    out = spans.join(used, [*by, "i"]).join(around, [*by, "i"], "left")
    pause = F.greatest(F.lit(0), F.col("a0") - F.coalesce("p", F.lit(0)))
    return out.select(*by, F.col("a0").alias("t_ini"), "t_fin", "cause", pause.cast(kind).alias("pause"), F.coalesce("before", F.lit("")).alias("before"), "heard")


def gaps_between(words: DataFrame, by: list[str], bounds: DataFrame, pre, post, min_gap) -> DataFrame:
    """Complement of the padded union of words inside the bounds, gaps of at least ``min_gap``."""
    padded = words.join(bounds, by).select(*by, F.greatest("lo", F.col("t_ini") - F.lit(pre)).alias("t_ini"), F.least("hi", F.col("t_fin") + F.lit(post)).alias("t_fin"))
    return complement(union(padded, by), by, bounds, min_gap)


def speaker_phrases(words: DataFrame, by: list[str], segments: DataFrame, segment: str, speaker: str, text: str, order: list) -> DataFrame:
    """Phrases: words of one segment (by midpoint) and one speaker in a row."""
    from .joins import asof

    mid = words.withColumn("mid", (F.col("t_ini") + F.col("t_fin")) / 2)
    at = asof(mid, segments.withColumn("__s", F.col("t_ini").cast("double")), by, "mid", "__s", [segment], prefix="seg_")
    w = Window.partitionBy(*by).orderBy("t_ini", *order)
    same = F.lag(f"seg_{segment}").over(w).eqNullSafe(F.col(f"seg_{segment}")) & F.lag(speaker).over(w).eqNullSafe(F.col(speaker)) & (F.row_number().over(w) > 1)
    run = at.withColumn("__new", (~same).cast("int")).withColumn("phrase", F.sum("__new").over(w))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_ini", *order, text))), lambda x: x[text]), " ")
    return run.groupBy(*by, "phrase").agg(F.first(f"seg_{segment}").alias(segment), F.first(speaker).alias(speaker), F.min("t_ini").alias("t_ini"), F.max("t_fin").alias("t_fin"), F.count("*").alias("n_words"), said.alias("text"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "np", "pd", "T", "F", "DataFrame", "Window")]


def hard_cuts(df: DataFrame, by: list[str], pos: str, changed: str, delta: str, least_changed: float = 0.60, least_delta: float = 25.0) -> DataFrame:
    """Samples where most of the picture changes at once."""
    return df.where((F.col(changed) > least_changed) & (F.col(delta) > least_delta)).select(*by, pos)


def gap_context(gaps: DataFrame, words: DataFrame, by: list[str], text: str, n: int, long_gap) -> DataFrame:
    """Each gap with the last ``n`` words before and the first ``n`` after it, and its class."""
    w = Window.partitionBy(*by).orderBy("t_ini", "t_fin", text)
    around = words.withColumn("said", F.array_join(F.collect_list(text).over(w.rowsBetween(-(n - 1), 0)), " ")).withColumn("follows", F.array_join(F.collect_list(text).over(w.rowsBetween(0, n - 1)), " "))
    from .joins import asof

    out = asof(gaps, around, by, "t_ini", "t_fin", ["said"], True, prefix="before_")
    out = asof(out, around, by, "t_fin", "t_ini", ["follows"], False, prefix="after_")
    kind = F.when(F.col("t_fin") - F.col("t_ini") >= F.lit(long_gap), "long").otherwise("short")
    return out.withColumn("kind", kind)
