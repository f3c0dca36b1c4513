"""Topic boundaries that know what is said: lexical change between the speech before and after a
place, from token bags that slide along the timeline.

An utterance enters the bag behind a candidate, leaves it, enters the bag ahead and leaves that at
four candidates, which two numberings and two as-of searches find. So a token's counts behind and ahead of the
candidates change only there, and so do their product and squares. The changes of all tokens, added up
along the timeline, are the dot product and the norms at every candidate: candidates are never
joined with the words around them, and a word costs four rows whatever the context is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.scratch import stored
from .joins import asof
from .scan import running


def context_dissimilarity(utterances: DataFrame, by: list[str], id_col: str, text: str, context, stop_words: tuple[str, ...] = tx.STOP_WORDS, slice_width=None) -> DataFrame:
    """One row for each utterance, the candidate boundary at its start: (by, n, id, t_ini, silence, dissimilarity).

    ``dissimilarity`` is 1 - cosine of the token counts of the utterances before it that end no more
    than ``context`` earlier, and of those from it on that begin no more than ``context`` later; 1 if one side
    has no token. ``silence`` is the pause since the end of the utterance before (0 at the first, and where they overlap).
    Utterances without a start or an end take no part; a null text has no tokens; n counts from 1 in the order
    of start, end and id."""
    rows = utterances.where("t_ini IS NOT NULL AND t_fin IS NOT NULL").select(*by, F.col(id_col).alias("id"), "t_ini", "t_fin", F.filter(tx.tokens(F.coalesce(F.col(text), F.lit(""))), lambda x: ~x.isin(*stop_words)).alias("tokens"))
    order = ["t_ini", "t_fin", "id"]
    rows = running(rows, by, order, {"n": ("count", F.lit(1))}, slice_width)
    rows = stored(running(rows, by, order, {"prev": ("last", F.col("t_fin"))}, slice_width, before=True), "topics")
    places = rows.select(*by, "n", "t_ini", (F.col("t_fin") + F.lit(context)).alias("forgotten"), (F.col("t_ini") - F.lit(context)).alias("foreseen"))
    starts = rows.select(*by, F.col("t_ini").alias("b"), F.col("n").alias("at"))
    places = asof(places, starts, by, "forgotten", "b", ["at"], False, False, prefix="out_", slice_width=slice_width)
    places = asof(places, starts, by, "foreseen", "b", ["at"], False, True, prefix="in_", slice_width=slice_width)
    places = places.select(*by, "n", F.col("out_at").alias("leaves"), F.col("in_at").alias("comes"))

    counted = rows.select(*by, "n", F.explode("tokens").alias("token")).groupBy(*by, "n", "token").agg(F.count("*").alias("c")).join(places, [*by, "n"])
    change = lambda at, behind, ahead: F.struct(at.alias("at"), behind.alias("behind"), ahead.alias("ahead"))
    c, none, after = F.col("c"), F.lit(0).cast("long"), F.col("n") + 1
    # behind from the next candidate until it is forgotten; ahead from where it is foreseen to its own
    left = F.when(F.col("leaves") > after, F.col("leaves")).otherwise(F.when(F.col("leaves").isNotNull(), after))
    changes = counted.select(*by, "token", F.explode(F.array(change(after, c, none), change(left, -c, none), change(F.col("comes"), none, c), change(after, none, -c))).alias("x"))
    changes = changes.select(*by, "token", "x.*").where("at IS NOT NULL").groupBy(*by, "token", "at").agg(F.sum("behind").alias("behind"), F.sum("ahead").alias("ahead"))
    w = Window.partitionBy(*by, "token").orderBy("at")
    bags = changes.withColumn("l", F.sum("behind").over(w)).withColumn("r", F.sum("ahead").over(w))
    was = lambda x, d: F.col(x) - F.col(d)
    deltas = bags.groupBy(*by, "at").agg(
        F.sum(F.col("l") * F.col("r") - was("l", "behind") * was("r", "ahead")).alias("d_dot"),
        F.sum(F.col("l") * F.col("l") - was("l", "behind") * was("l", "behind")).alias("d_ll"),
        F.sum(F.col("r") * F.col("r") - was("r", "ahead") * was("r", "ahead")).alias("d_rr"),
    )
    lined = rows.select(*by, "n", "id", "t_ini", "prev").join(deltas.withColumnRenamed("at", "n"), [*by, "n"], "left")
    lined = running(lined, by, ["n"], {x: ("sum", F.col(f"d_{x}")) for x in ("dot", "ll", "rr")}, None if slice_width is None else 65_536)
    cosine = F.when((F.col("ll") > 0) & (F.col("rr") > 0), F.col("dot") / (F.sqrt("ll") * F.sqrt("rr"))).otherwise(0.0)
    return lined.select(*by, "n", "id", "t_ini", F.greatest(F.lit(0), F.col("t_ini") - F.coalesce("prev", "t_ini")).alias("silence"), (1 - cosine).alias("dissimilarity"))


def boundary_scores(utterances: DataFrame, by: list[str], id_col: str, text: str, context, pause, excitement: Column | None = None, stop_words: tuple[str, ...] = tx.STOP_WORDS, slice_width=None) -> DataFrame:
    """The worth of a boundary before each utterance but the first: 0.72 of the dissimilarity, 0.20 of the silence
    as a share of ``pause`` (1 at most), less ``excitement``: (by, id, t, score, dissimilarity, silence). How far
    it lies from where it should be is the plan's part."""
    out = context_dissimilarity(utterances, by, id_col, text, context, stop_words, slice_width).where("n > 1")
    score = 0.72 * F.col("dissimilarity") + 0.20 * F.least(F.lit(1.0), F.col("silence") / F.lit(pause))
    if excitement is not None:
        out = out.join(utterances.select(*by, F.col(id_col).alias("id"), excitement.alias("__less")), [*by, "id"])
        score = score - F.coalesce("__less", F.lit(0.0))
    return out.select(*by, "id", F.col("t_ini").alias("t"), score.alias("score"), "dissimilarity", "silence")
