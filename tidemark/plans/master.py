"""Building the master of a recording: streams united, words enriched, ids, views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as tm
from ..operators.documents import stable_ids
from ..operators.stats import zscore


def consolidate(streams: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Typed event tables united into one, each with its stream name and stable ids. Columns that
    a stream lacks are null."""
    named = [df.withColumn("stream", F.lit(name)) for name, df in streams.items()]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return stable_ids(united, [*by, "stream"], "ev-", ["t_ini", "t_fin", "event_id"])


def enrich_words(words: DataFrame, signal: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Words joined one to one with a signal by position; rows without a partner are an error row."""
    both = words.join(signal, [*by, pos], "full_outer")
    return both.withColumn("mismatch", F.col("t_ini").isNull() | F.col("signal").isNull())


def word_map(words: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """id -> position and time."""
    w = Window.partitionBy(*by).orderBy("t_ini", "t_fin", id_col)
    return words.select(*by, id_col, (F.row_number().over(w) - 1).alias("pos"), "t_ini", "t_fin")


def numbered_words(words: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Words in order with ids w000000, w000001, ..."""
    return stable_ids(words, by, "w", ["t_ini", tie], 6)


def transcript(rows: DataFrame, by: list[str], who: str, text: str, tie: str) -> DataFrame:
    """One text per recording: a line for each row in time order. The ordered list is built per
    recording, whose size bounds it."""
    line = F.concat(F.lit("["), tm.format_ms(F.col("t_ini")), F.lit("] "), F.col(who), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("t_ini", tie, line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(*by).agg(F.array_join(lines, "\n").alias("transcript"), F.count("*").alias("n_lines"))


def interleaved(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Two streams of lines (t, kind, line) as one, in time, with their order number."""
    both = left.unionByName(right)
    w = Window.partitionBy(*by).orderBy("t", "kind", "line")
    return both.withColumn("line_no", F.row_number().over(w))


def signals(events: DataFrame, by: list[str], value: str, least: float, most: int) -> DataFrame:
    """The first ``most`` events of each recording whose z is at least ``least``."""
    z = zscore(events, by, value).where(F.col(f"{value}_z") >= least)
    w = Window.partitionBy(*by).orderBy("t_ini", "event_id")
    return z.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def dossier(events: DataFrame, by: list[str], lo, hi, context) -> DataFrame:
    """Everything around a moment: events inside it, and those of the context before and after."""
    a, b = F.lit(lo), F.lit(hi)
    near = events.where((F.col("t_ini") < b + F.lit(context)) & (F.col("t_fin") > a - F.lit(context)))
    place = F.when((F.col("t_ini") < b) & (F.col("t_fin") > a), "inside").when(F.col("t_fin") <= a, "before").otherwise("after")
    return near.withColumn("place", place)


def subtitles(rows: DataFrame, by: list[str], text: str, tie: str) -> DataFrame:
    """Numbered subtitle entries of each recording."""
    w = Window.partitionBy(*by).orderBy("t_ini", tie)
    span = F.concat(tm.format_ms(F.col("t_ini"), ","), F.lit(" --> "), tm.format_ms(F.col("t_fin"), ","))
    return rows.select(*by, tie, F.row_number().over(w).alias("no"), span.alias("span"), F.col(text).alias("body"))


def edit_list(pieces: DataFrame, by: list[str], fps: int) -> DataFrame:
    """Lines of an edit decision list: number, source and record time codes."""
    codes = [tm.frames(F.col(c), fps) for c in ("source_ini", "source_fin", "seq_ini", "seq_fin")]
    line = F.concat_ws(" ", F.format_string("%03d", F.col("pos") + 1), F.lit("AX"), F.lit("V"), F.lit("C"), *codes)
    return pieces.select(*by, "pos", line.alias("line"))


def filter_script(kept: DataFrame, by: list[str]) -> DataFrame:
    """Trim and join instructions for a media encoder, one text per recording."""
    part = F.format_string("[0:a]atrim=start=%.3f:end=%.3f,asetpts=PTS-STARTPTS[a%d]", F.col("t_ini") / 1000, F.col("t_fin") / 1000, F.col("n"))
    w = Window.partitionBy(*by).orderBy("t_ini", "t_fin")
    rows = kept.withColumn("n", F.row_number().over(w) - 1).withColumn("part", part)
    parts = F.array_sort(F.collect_list(F.struct("n", "part")))
    labels = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("[a"), x["n"].cast("string"), F.lit("]"))), "")
    graph = F.concat(F.array_join(F.transform(parts, lambda x: x["part"]), ";"), F.lit(";"), labels, F.lit("concat=n="), F.size(parts).cast("string"), F.lit(":v=0:a=1[out]"))
    return rows.groupBy(*by).agg(graph.alias("script"))
