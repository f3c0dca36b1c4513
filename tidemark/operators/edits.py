"""Edits of documents as whole-table transformations: the changes of many users are tables too.

Ids are unique inside ``by``. Nothing is changed in place: each function returns the new rows, and
``edited`` tells those that a hand touched. Changes that name no row are ignored; a null change
leaves a field as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def add_rows(rows: DataFrame, new: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """Inserts rows whose id is not taken, marked as edited."""
    fresh = new.join(rows.select(*by, id_col), [*by, id_col], "left_anti").withColumn("edited", F.lit(True))
    return rows.withColumn("edited", F.coalesce(rows["edited"], F.lit(False)) if "edited" in rows.columns else F.lit(False)).unionByName(fresh)


def remove_rows(rows: DataFrame, gone: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """Deletes the rows that ``gone`` names."""
    return rows.join(gone.select(*by, id_col).distinct(), [*by, id_col], "left_anti")


def set_state(rows: DataFrame, chosen: DataFrame, by: list[str], id_col: str, state: str) -> DataFrame:
    """Sets the state of many rows at once."""
    marked = chosen.select(*by, id_col).distinct().withColumn("__state", F.lit(state))
    return rows.join(marked, [*by, id_col], "left").withColumn("state", F.coalesce("__state", "state")).drop("__state")


def update_text(rows: DataFrame, changes: DataFrame, by: list[str], id_col: str, columns: list[str]) -> DataFrame:
    """Replaces text fields; ``edited`` is true where one became another."""
    new = changes.select(*by, id_col, *[F.col(c).alias(f"__{c}") for c in columns])
    both = rows.join(new, [*by, id_col], "left")
    differs = [F.coalesce(F.col(f"__{c}") != F.coalesce(F.col(c), F.lit("")), F.lit(False)) for c in columns]
    edited = F.greatest(*differs) if len(differs) > 1 else differs[0]
    both = both.withColumn("edited", edited)
    return both.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def append_clips(clips: DataFrame, new: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """New clips after the last of each sequence, one behind the other in order of their ids.

    clips: seq_ini, source_ini, source_fin; new: source_ini, source_fin."""
    end = clips.groupBy(*by).agg(F.max(F.col("seq_ini") + F.col("source_fin") - F.col("source_ini")).alias("__end"))
    w = Window.partitionBy(*by).orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("source_fin") - F.col("source_ini")).over(w), F.lit(0))
    placed = new.join(end, by, "left").withColumn("seq_ini", F.coalesce("__end", F.lit(0)) + before).drop("__end")
    return clips.unionByName(placed.select(*clips.columns))


def split_clips(clips: DataFrame, points: DataFrame, by: list[str], id_col: str, at: str) -> DataFrame:
    """Cuts clips at sequence times strictly inside them: (by, id, part, seq_ini, source_ini, source_fin)."""
    length = F.col("source_fin") - F.col("source_ini")
    cuts = clips.join(points.select(*by, id_col, F.col(at).alias("__at")).distinct(), [*by, id_col])
    cuts = cuts.where((F.col("__at") > F.col("seq_ini")) & (F.col("__at") < F.col("seq_ini") + length))
    starts = clips.withColumn("__from", F.col("source_ini")).unionByName(cuts.withColumn("__from", F.col("source_ini") + F.col("__at") - F.col("seq_ini")).drop("__at"))
    w = Window.partitionBy(*by, id_col).orderBy("__from")
    out = starts.withColumn("part", F.row_number().over(w)).withColumn("__to", F.coalesce(F.lead("__from").over(w), "source_fin"))
    return out.select(*by, id_col, "part", (F.col("seq_ini") + F.col("__from") - F.col("source_ini")).alias("seq_ini"), F.col("__from").alias("source_ini"), F.col("__to").alias("source_fin"))


def stable_id(prefix: str, *columns: str) -> Column:
    """An id that depends on the given fields only."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256), 1, 12))


def next_number(rows: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """The next free number of ids that end in one: (by, next_no)."""
    number = F.regexp_extract(F.col(id_col), r"(\d+)$", 1).try_cast("long")
    return rows.groupBy(*by).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_no"))


def desired_count(length, target, longest) -> Column:
    """Chunks that a timeline needs: no fewer than its length over the target or over the limit, rounded up."""
    return F.greatest(F.lit(1), F.ceil(length / F.lit(target)), F.ceil(length / F.lit(longest))).cast("long")


def rectangles(a: list[str], b: list[str]) -> tuple[Column, Column, Column, Column]:
    """Common part of two rectangles (left, top, right, bottom); nulls where they only touch or are apart."""
    x1, y1 = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    x2, y2 = F.least(a[2], b[2]), F.least(a[3], b[3])
    common = (x1 < x2) & (y1 < y2)
    return tuple(F.when(common, v) for v in (x1, y1, x2, y2))


def cycle_state(requested, answered, applied, failed) -> Column:
    """Where a request stands, from the times of its steps: idle, failed, waiting, answered, applied."""
    return F.when(requested.isNull(), "idle").when(failed.isNotNull() & (failed >= requested), "failed").when(answered.isNull() | (answered < requested), "waiting").when(applied.isNull() | (applied < answered), "answered").otherwise("applied")


def spread(samples: DataFrame, by: list[str], t: str, value: str, width) -> DataFrame:
    """Standard deviation of the measured (not null, above zero) values of each stretch of ``width``,
    as of a pitch curve; null under two values."""
    chunk = F.floor(F.col(t) / F.lit(width)).cast("long")
    rows = samples.withColumn("chunk_no", chunk)
    measured = F.when(F.col(value) > 0, F.col(value))
    return rows.groupBy(*by, "chunk_no").agg(F.count(measured).alias("n"), F.when(F.count(measured) >= 2, F.stddev_pop(measured)).alias("spread"))


# ---- lanes and tracks


def remove_lanes(lanes: DataFrame, cuts: DataFrame, removals: DataFrame, by: list[str], fixed: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Takes lanes away: their cuts move to ``move_to``, or go with them where that is null.

    lanes and removals have ``lane``; fixed lanes, unknown lanes, and lanes whose target is unknown or
    itself stay as they are."""
    known = lanes.select(*by, "lane").distinct()
    ask = removals.select(*by, "lane", "move_to").distinct().where(~F.col("lane").isin(*fixed) if fixed else F.lit(True)).join(known, [*by, "lane"])
    target = ask.where("move_to IS NOT NULL AND move_to <> lane").join(known.withColumnRenamed("lane", "move_to"), [*by, "move_to"])
    gone = target.select(*by, "lane", "move_to").unionByName(ask.where("move_to IS NULL")).withColumn("__gone", F.lit(True))
    moved = cuts.join(gone, [*by, "lane"], "left").where("__gone IS NULL OR move_to IS NOT NULL")
    moved = moved.withColumn("lane", F.coalesce("move_to", "lane")).select(*cuts.columns)
    return lanes.join(gone.select(*by, "lane"), [*by, "lane"], "left_anti"), moved


def insert_move(clips: DataFrame, moves: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """Moves one clip of each timeline to ``to_ini`` on ``to_track`` (null: its own): the clips behind it close
    up, a place inside another clip becomes that clip's nearer edge (ties: its end), and the clips from there on make room.

    clips: track, seq_ini, seq_fin. moves: one row a timeline; a move of an unknown clip changes nothing."""
    m = moves.join(clips.select(*by, id_col, F.col("track").alias("__track"), F.col("seq_ini").alias("__ini"), F.col("seq_fin").alias("__fin")), [*by, id_col])
    m = m.select(*by, F.col(id_col).alias("__id"), F.greatest("to_ini", F.lit(0)).alias("__to"), F.coalesce("to_track", "__track").alias("__onto"), "__track", "__fin", (F.col("__fin") - F.col("__ini")).alias("__len"))
    both = clips.join(m, by, "left").withColumn("__self", F.coalesce(F.col(id_col) == F.col("__id"), F.lit(False)))
    back = F.when(~F.col("__self") & (F.col("track") == F.col("__track")) & (F.col("seq_ini") >= F.col("__fin")), F.col("__len")).otherwise(0)
    both = both.withColumn("__back", back).withColumn("__a", F.col("seq_ini") - F.col("__back")).withColumn("__b", F.col("seq_fin") - F.col("__back"))
    inside = both.where(~F.col("__self") & (F.col("track") == F.col("__onto")) & (F.col("__a") < F.col("__to")) & (F.col("__to") < F.col("__b")))
    nearer = F.when(F.col("__to") - F.col("__a") < F.col("__b") - F.col("__to"), F.col("__a")).otherwise(F.col("__b"))
    edge = inside.groupBy(*by).agg(F.min_by(nearer, "__a").alias("__edge"))
    both = both.join(edge, by, "left").withColumn("__to", F.coalesce("__edge", "__to"))
    on = F.when(~F.col("__self") & (F.col("track") == F.col("__onto")) & (F.col("__a") >= F.col("__to")), F.col("__len")).otherwise(0)
    start = F.when(F.col("__self"), F.col("__to")).otherwise(F.coalesce(F.col("__a") + on, "seq_ini"))
    new = both.withColumn("__start", start).withColumn("seq_fin", F.col("__start") + F.col("seq_fin") - F.col("seq_ini")).withColumn("seq_ini", F.col("__start"))
    return new.withColumn("track", F.when(F.col("__self"), F.col("__onto")).otherwise(F.col("track"))).select(*clips.columns)


def shift_set(clips: DataFrame, chosen: DataFrame, by: list[str], id_col: str, delta, track_delta: int = 0) -> DataFrame:
    """Shifts the chosen clips together in time and over tracks (whole numbers from 1), by as much as keeps all of them from
    falling before 0 or below the first track. Where one would come to lie over a clip that stays, the timeline stays as it was.
    Adds ``moved``: did the clip move?"""
    marked = clips.join(chosen.select(*by, id_col).distinct().withColumn("__chosen", F.lit(True)), [*by, id_col], "left").withColumn("__chosen", F.coalesce("__chosen", F.lit(False)))
    least = marked.where("__chosen").groupBy(*by).agg(F.greatest(F.lit(delta), -F.min("seq_ini")).alias("__d"), F.greatest(F.lit(track_delta), 1 - F.min("track")).alias("__t"))
    new = marked.join(least, by, "left")
    step = lambda c, d: F.when(F.col("__chosen"), F.col(c) + F.col(d)).otherwise(F.col(c))
    new = new.withColumn("__n", step("track", "__t")).withColumn("__a", step("seq_ini", "__d")).withColumn("__b", step("seq_fin", "__d"))
    # clips of a track don't overlap, so one that is covered shows between neighbours: the furthest end of the others so far
    w = Window.partitionBy(*by, "__n").orderBy("__a", "__b", id_col).rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(F.col("__chosen"), F.max(F.when(~F.col("__chosen"), F.col("__b"))).over(w)).otherwise(F.max(F.when(F.col("__chosen"), F.col("__b"))).over(w))
    hit = new.withColumn("__hit", other > F.col("__a")).groupBy(*by).agg(F.max("__hit").alias("__over"))
    out = new.join(hit, by).withColumn("moved", F.col("__chosen") & ~F.coalesce("__over", F.lit(False)))
    return out.withColumns({c: F.when(F.col("moved"), F.col(x)).otherwise(F.col(c)) for c, x in (("track", "__n"), ("seq_ini", "__a"), ("seq_fin", "__b"))}).select(*clips.columns, "moved")


def spare_tracks(tracks: DataFrame, clips: DataFrame, by: list[str]) -> DataFrame:
    """The tracks from 1 to one above the highest that has a clip: declared ones keep their fields, missing ones are
    added, empty ones further up go. Timelines without clips keep the first track only."""
    top = tracks.select(*by).unionByName(clips.select(*by)).distinct().join(clips.groupBy(*by).agg(F.max("track").alias("top")), by, "left")
    wanted = top.select(*by, F.explode(F.sequence(F.lit(1), F.coalesce("top", F.lit(0)) + 1)).alias("track"))
    return wanted.join(tracks, [*by, "track"], "left")
