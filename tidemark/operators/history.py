"""Replay of edit logs: revisions, refusal of stale changes, undo and redo, state at any revision.

A log has one row for each operation asked for, of many documents: an ``edit`` sets a field of a key to a value,
an ``undo`` takes back the latest edit that stands, a ``redo`` brings back the one taken back last, as long as no edit came between.
An operation names the revision it was made on, or none; every operation that is applied raises the document's revision by
one. One made on another revision than the current is ``stale``, an undo or redo that finds nothing is ``nothing``; both change nothing.

Which of those that name a revision are applied is a chain: each is followed by the first later one that needs one more of them before it,
found for all at once and followed by doubling. What stands is a
matter of heights: an edit or redo goes one up, an undo one down, and the edit at a height is the last one that reached
it. So the state at a revision are the edits at the heights up to the revision's own, the
highest for each field. All of it windows and joins over the log, with no document in one task where ``width`` slices it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import apart, stored
from .joins import asof
from .scan import follow, running


def _applied(log: DataFrame, by: list[str], width) -> DataFrame:
    """(by, seq, revision) of the operations that are not stale.

    An unconditional operation is always applied, so one made on revision b needs as many conditional ones applied
    before it as b less the unconditional ones before it: the applied conditional ones need 0, 1, 2, ..."""
    placed = running(log.select(*by, "seq", "base"), by, ["seq"], {"free": ("count", F.when(F.col("base").isNull(), 1))}, width)
    need = placed.where("base IS NOT NULL").select(*by, "seq", (F.col("base") - F.col("free")).alias("need")).where("need >= 0")
    need = stored(need, "history")
    after = asof(need.withColumn("more", F.col("need") + 1).drop("need"), need.select(*by, F.col("need").alias("more"), F.col("seq").alias("s")), [*by, "more"], "seq", "s", [], False, False, prefix="next_", slice_width=width)
    first = need.where("need = 0").groupBy(*by).agg(F.min("seq").alias("at"))
    found = follow(after.select(*by, F.col("seq").alias("at"), F.col("next_t").alias("to")), first, by)
    every = log.where("base IS NULL").select(*by, "seq").unionByName(found.withColumnRenamed("at", "seq"))
    return running(every, by, ["seq"], {"revision": ("count", F.lit(1))}, width)


def replay(log: DataFrame, by: list[str], width=None) -> DataFrame:
    """The log (by, seq, kind, base, ...) with ``outcome`` (applied, stale or nothing), ``revision`` (of the document after the
    operation), ``height`` (edits that stand then, null if not applied) and ``target`` (the edit that was made, taken back or brought back).

    seq is a whole number, distinct within a document, and gives the order; a null base makes an operation unconditional; rows with
    another kind, or without seq, are not applied and have no outcome."""
    known = stored(log.where("seq IS NOT NULL AND kind IN ('edit', 'undo', 'redo')").select(*by, F.col("seq").cast("long").alias("seq"), "kind", F.col("base").cast("long").alias("base")), "history")
    rest, parts, nothing = known, [], known.select(*by, "seq").limit(0)
    while True:
        done = rest.join(apart(_applied(rest, by, width)), [*by, "seq"])
        step = F.when(F.col("kind") == "undo", -1).otherwise(1)
        done = running(done.withColumn("step", step), by, ["seq"], {"height": ("sum", F.col("step"))}, width)
        done = stored(running(done, by, ["seq"], {"top": ("last", F.when(F.col("kind") == "edit", F.col("height")))}, width).drop("step"), "history")
        # the first operation of a document that finds nothing is no operation; such a document is looked at anew, the others are done
        wrong = done.where((F.col("height") < 0) | (F.col("kind") == "redo") & (F.col("height") > F.coalesce("top", F.lit(0))))
        wrong = stored(wrong.groupBy(*by).agg(F.min("seq").alias("seq")), "history")
        if wrong.isEmpty():
            parts.append(done)
            break
        parts.append(done.join(apart(wrong.select(*by)), by, "left_anti"))
        nothing = nothing.unionByName(wrong)
        rest = stored(rest.join(apart(wrong.withColumnRenamed("seq", "__none")), by).where("seq <> __none").drop("__none"), "history")
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    level = F.when(F.col("kind") == "undo", F.col("height") + 1).otherwise(F.col("height"))
    there = Window.partitionBy(*by, "level").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    done = done.withColumn("level", level).withColumn("target", F.last(F.when(F.col("kind") == "edit", F.col("seq")), True).over(there))
    out = known.select(*by, "seq").join(apart(done.select(*by, "seq", F.col("revision").alias("made"), "height", "target")), [*by, "seq"], "left")
    out = out.join(apart(nothing.withColumn("none", F.lit(True))), [*by, "seq"], "left")
    out = running(out, by, ["seq"], {"revision": ("max", F.col("made"))}, width).withColumn("revision", F.coalesce("revision", F.lit(0)))
    outcome = F.when(F.col("made").isNotNull(), "applied").when(F.col("none"), "nothing").otherwise("stale")
    return log.join(apart(out.select(*by, "seq", outcome.alias("outcome"), "revision", "height", "target")), [*by, "seq"], "left")


def state_at(replayed: DataFrame, by: list[str], fields: list[str], value: str, revision: DataFrame | None = None) -> DataFrame:
    """(by, fields, value, seq): the value of each field at the given revision (by, revision) of its document, or at
    the last one. A document below that revision has its last state; an edit to null stands as null."""
    done = replayed.where("outcome = 'applied'")
    if revision is not None:
        done = done.join(apart(revision.select(*by, F.col("revision").alias("asked"))), by).where("revision <= asked")
    # looked at twice below, and a replay isn't to run for each
    done = stored(done.select(*by, *fields, F.col(value).alias("__value"), "seq", "kind", "revision", "height"), "history")
    now = done.groupBy(*by).agg(F.max_by("height", "revision").alias("now"))
    edits = done.where("kind = 'edit'").join(apart(now), by).where("height <= now")
    held = edits.groupBy(*by, "height").agg(F.max_by(F.struct(*fields, F.col("__value").alias("value"), "seq"), "revision").alias("e"))
    return held.groupBy(*by, *(F.col(f"e.{f}").alias(f) for f in fields)).agg(F.max_by(F.struct("e.value", "e.seq"), "height").alias("v")).select(*by, *fields, F.col("v.value").alias(value), F.col("v.seq").alias("seq"))
