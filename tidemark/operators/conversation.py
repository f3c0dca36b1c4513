"""Conversations on several tracks: overlap groups, bleed duplicates, readable blocks, merges."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.scratch import stored
from .greedy import matching, ranked
from .intervals import islands
from .joins import asof, overlap_join
from .scan import follow, running


def overlap_groups(utterances: DataFrame, by: list[str], track: str, id_col: str) -> DataFrame:
    """Components of strictly overlapping utterances on at least two tracks, numbered in time:
    (by, group_no, t_ini, t_fin, n, tracks)."""
    runs = islands(utterances, by, touching=False, order=[track, id_col])
    groups = runs.groupBy(*by, "island").agg(F.min("t_ini").alias("t_ini"), F.max("t_fin").alias("t_fin"), F.count("*").alias("n"), F.count_distinct(track).alias("n_tracks"), F.array_join(F.array_sort(F.collect_set(track)), ",").alias("tracks"))
    w = Window.partitionBy(*by).orderBy("t_ini")
    return groups.where("n_tracks >= 2").withColumn("group_no", F.row_number().over(w)).drop("island", "n_tracks")


def cross_track_intersections(utterances: DataFrame, by: list[str], track: str, id_col: str, bin_width=None) -> DataFrame:
    """Common parts of utterances of different tracks, each pair once."""
    right = utterances.select(*by, F.col(track).alias("r_track"), F.col(id_col).alias("r_id"), F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"))
    hit = overlap_join(utterances.select(*by, track, id_col, "t_ini", "t_fin"), right, by, bin_width=bin_width)
    hit = hit.where((F.col(id_col) < F.col("r_id")) & (F.col(track) != F.col("r_track")))
    return hit.select(*by, F.col(id_col).alias("left_id"), F.col("r_id").alias("right_id"), F.greatest("t_ini", "r_ini").alias("x_ini"), F.least("t_fin", "r_fin").alias("x_fin"))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts; null where one is null."""
    return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def likeness(x: str, y: str) -> float:
    """The ratio of a SequenceMatcher; a text that the other holds whole is their longest match, with nothing left to compare."""
    if x in y or y in x:
        return 2.0 * min(len(x), len(y)) / (len(x) + len(y)) if x or y else 1.0
    return SequenceMatcher(None, x, y, autojunk=False).ratio()


def similarity_from(least: float):
    """As ``similarity``, but null where the letters that both texts have show that it is less than ``least``."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        near = lambda x, y: x is not None and y is not None and (x in y or y in x or SequenceMatcher(None, x, y, autojunk=False).quick_ratio() >= least)
        return pd.Series([likeness(x, y) if near(x, y) else None for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def bleed_duplicates(utterances: DataFrame, by: list[str], track: str, id_col: str, text: str, quality: list[str], least_overlap=0.8, least_similarity=0.92, least_chars=8, bin_width=None) -> DataFrame:
    """Near-equal utterances heard on two tracks at once: (by, primary_id, secondary_id, similarity).

    Candidates come from the overlap join. Lengths, then the letters that both texts have, bound the similarity from above before
    texts are compared. Of all pairs in time order each utterance is claimed once, by rounds on all timelines
    at once; the better quality is primary. A null text is similar to nothing; ids are distinct within a timeline."""
    rows = utterances.select(*by, F.col(track).alias("track"), F.col(id_col).alias("id"), "t_ini", "t_fin", F.col(text).alias("text"), F.struct(*quality).alias("q")).where(F.length("text") >= least_chars * least_similarity / (2 - least_similarity))
    rows = stored(rows, "bleed")  # texts are made once, and the plan of the pairs stays small
    left = rows.select(*by, *(F.col(c).alias(f"o_{c}") for c in ("track", "id", "t_ini", "t_fin", "text", "q")))
    pairs = overlap_join(rows, left, by, ("t_ini", "t_fin"), ("o_t_ini", "o_t_fin"), bin_width=bin_width)
    earlier = F.struct(F.col("o_t_ini"), F.col("o_track"), F.col("o_t_fin"), F.col("o_id")) < F.struct(F.col("t_ini"), F.col("track"), F.col("t_fin"), F.col("id"))
    shared = F.least("t_fin", "o_t_fin") - F.greatest("t_ini", "o_t_ini")
    shorter = F.least(F.col("t_fin") - F.col("t_ini"), F.col("o_t_fin") - F.col("o_t_ini"))
    pairs = pairs.where((F.col("track") != F.col("o_track")) & earlier & (F.length("text") >= least_chars) & (shared >= F.lit(least_overlap) * shorter) & (shorter > 0))
    both, fewer = F.length("text") + F.length("o_text"), F.least(F.length("text"), F.length("o_text"))
    pairs = pairs.where(2 * fewer >= least_similarity * both).withColumn("held", F.contains("text", "o_text") | F.contains("o_text", "text"))
    # texts go to Python only where neither holds the other, when the shorter is all that they share
    open_text = lambda c: F.when(~F.col("held"), F.col(c))
    pairs = pairs.withColumn("similarity", F.when(F.col("held"), 2.0 * fewer / both).otherwise(similarity_from(least_similarity)(open_text("text"), open_text("o_text")))).where(F.col("similarity") >= least_similarity)
    pairs = pairs.select(*by, "t_ini", "track", "t_fin", "id", "o_t_ini", "o_track", "o_t_fin", "o_id", "similarity", (F.col("q") > F.col("o_q")).alias("first_better"))
    order = ["t_ini", "track", "t_fin", "id", "o_t_ini", "o_track", "o_t_fin", "o_id"]
    taken = matching(ranked(pairs, by, order).select(*by, "id", "o_id", "similarity", "first_better", "rank_no"), by, "id", "o_id", "rank_no")
    one, two = F.when(F.col("first_better"), F.col("id")).otherwise(F.col("o_id")), F.when(F.col("first_better"), F.col("o_id")).otherwise(F.col("id"))
    return taken.select(*by, one.alias("primary_id"), two.alias("secondary_id"), "similarity")


def readable_blocks(utterances: DataFrame, by: list[str], track: str, speaker: str, id_col: str, text: str, blocked: str, max_gap, max_span, max_words: int, slice_width=None) -> DataFrame:
    """Blocks of consecutive utterances of one speaker and track with gaps of 0 to ``max_gap``, bounded in
    time and words; utterances marked ``blocked`` stay alone: (by, block_no, track, speaker, t_ini, t_fin, n, words, text).

    Where a block from any utterance would end follows from the next break between neighbours and from two
    searches, for the last end inside the span and the last word inside the count; the blocks that
    exist are found by following these steps. An utterance beyond a bound is a block of its own. A null text has no words, a null
    ``blocked`` is false, an end before its start counts as the start; utterances without a time take no part."""
    end = F.greatest("t_ini", "t_fin")
    said = F.trim(F.coalesce(F.col(text), F.lit("")))
    rows = utterances.where("t_ini IS NOT NULL").select(*by, F.col(id_col).alias("id"), F.col(track).alias("track"), F.col(speaker).alias("speaker"), "t_ini", end.alias("t_fin"), said.alias("said"), F.coalesce(F.col(blocked), F.lit(False)).alias("blocked"))
    rows = rows.withColumn("words", F.when(F.col("said") == "", 0).otherwise(F.size(F.split("said", r"\s+"))))
    order = ["t_ini", "t_fin", "id"]
    whole = F.struct("t_fin", "track", "speaker", "blocked")
    rows = running(rows, by, order, {"n": ("count", F.lit(1)), "upto": ("sum", F.col("words"))}, slice_width)
    rows = running(rows, by, order, {"prev": ("last", whole)}, slice_width, before=True)
    near = (F.col("t_ini") - F.col("prev.t_fin")).between(F.lit(0), F.lit(max_gap))
    alike = F.col("prev.speaker").eqNullSafe(F.col("speaker")) & F.col("prev.track").eqNullSafe(F.col("track"))
    linked = F.col("prev").isNotNull() & near & alike & ~F.col("blocked") & ~F.col("prev.blocked")
    rows = running(rows.withColumn("fresh", (~linked).cast("int")), by, order, {"strand": ("sum", F.col("fresh"))}, slice_width)
    rows = stored(rows.drop("prev", "fresh").withColumn("latest", F.col("t_ini") + F.lit(max_span)).withColumn("most", F.col("upto") - F.col("words") + F.lit(max_words)), "blocks")
    strand = [*by, "strand"]
    steps = asof(rows.select(*strand, "n", "latest", "most"), rows.select(*strand, "t_fin", "n"), strand, "latest", "t_fin", ["n"], prefix="time_", slice_width=slice_width)
    steps = asof(steps, rows.select(*strand, "upto", "n"), strand, "most", "upto", ["n"], prefix="word_", slice_width=None if slice_width is None else 64 * max_words)
    last = F.least(F.coalesce("time_n", F.lit(0)), F.coalesce("word_n", F.lit(0)))
    steps = steps.select(*by, F.col("n").alias("at"), (F.greatest(F.col("n"), last) + 1).alias("to"))
    starts = follow(steps, rows.where("n = 1").select(*by, F.col("n").alias("at")), by)
    begun = rows.join(starts.withColumn("begins", F.lit(1)), [F.col("n") == F.col("at"), *(rows[c] == starts[c] for c in by)], "left").select(*(rows[c] for c in rows.columns), "begins")
    placed = running(begun, by, order, {"block_no": ("sum", F.col("begins"))}, slice_width)
    lines = F.array_sort(F.collect_list(F.when(F.col("said") != "", F.struct("n", "said"))))
    out = placed.groupBy(*by, F.col("block_no").cast("int").alias("block_no")).agg(
        F.min_by("track", "n").alias("track"), F.min_by("speaker", "n").alias("speaker"), F.min("t_ini").alias("t_ini"), F.max("t_fin").alias("t_fin"), F.count("*").cast("int").alias("n"), F.sum("words").cast("int").alias("words"), F.array_join(F.transform(lines, lambda x: x["said"]), " ").alias("text")
    )
    return out.select(*by, "block_no", "track", "speaker", "t_ini", "t_fin", "n", "words", "text")
