"""The signal index: the moments worth a look, by lanes with quotas, each as a record with what
happened together and what led up to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.intervals import Convention
from ..operators.joins import overlap_join
from ..operators.planning import quota_select
from ..operators.sequence import sessions
from ..sources.scratch import apart, stored

#: The lane of moments in which peaks of several modalities meet.
MULTIMODAL = "multimodal"


def nuclei(pool: DataFrame, by: list[str], near) -> DataFrame:
    """Peaks of at least two modalities with steps of at most ``near`` between them, as one candidate: the strength is the
    mean of the two best ranks. pool: by, id, modality, t_ini, t_fin, t_peak, rank, value.
    (by, id, lane, t_ini, t_fin, t_peak, rank, members); the id is that of its first peak, with ``n:`` before it."""
    member = F.struct("t_peak", F.col("id").cast("string").alias("id"), "modality", "value", "rank")
    groups = sessions(pool, by, "t_peak", near, ["id"]).groupBy(*by, "session").agg(
        F.min("t_ini").alias("t_ini"), F.max("t_fin").alias("t_fin"), F.count_distinct("modality").alias("kinds"), F.sort_array(F.collect_list(member)).alias("members"), F.sort_array(F.collect_list("rank"), asc=False).alias("ranks")
    )
    out = groups.where("kinds >= 2").withColumn("rank", (F.col("ranks")[0] + F.col("ranks")[1]) / 2)
    return out.select(*by, F.concat(F.lit("n:"), F.col("members")[0]["id"]).alias("id"), F.lit(MULTIMODAL).alias("lane"), "t_ini", "t_fin", F.col("members")[0]["t_peak"].alias("t_peak"), "rank", "members")


def build_ups(moments: DataFrame, pauses: DataFrame, by: list[str], reach, most: int = 3) -> DataFrame:
    """(by, id, build_up): the first ``most`` of the pauses (by, id, t_ini, t_fin) that end within ``reach`` before a moment (by, id, t_peak).

    A window over both in time order, with a frame of ``reach``: moments and pauses are not joined."""
    pause = F.struct("t_ini", "t_fin", F.col("id").cast("string").alias("id"))
    none = F.lit(None).cast("string")
    both = moments.select(*by, F.col("t_peak").alias("t"), F.col("id").cast("string").alias("moment"), F.lit(None).cast(pauses.select(pause.alias("p")).schema["p"].dataType).alias("pause"))
    both = both.unionByName(pauses.select(*by, F.col("t_fin").alias("t"), none.alias("moment"), pause.alias("pause")))
    w = Window.partitionBy(*by).orderBy("t").rangeBetween(-(reach - 1), Window.currentRow)  # the pause ends after t_peak - reach
    held = F.slice(F.sort_array(F.collect_list("pause").over(w)), 1, most)
    return both.withColumn("build_up", held).where("moment IS NOT NULL").select(*by, F.col("moment").alias("id"), "build_up")


def signal_index(
    pool: DataFrame, by: list[str], phrases: DataFrame, pauses: DataFrame, lengths: DataFrame, orders: DataFrame, lanes: list[str], quotas: dict[str, int], per, near, spacing, reach, margin, bin_width=None,
) -> tuple[DataFrame, DataFrame]:
    """The seeds and the refused candidates.

    pool: candidate peaks (by, id, modality, t_ini, t_fin, t_peak, rank, value), a lane for each modality, after ``multimodal``;
    orders: rows of the same columns that always enter; phrases (by, id, t_ini, t_fin): two
    candidates that touch the same phrase within ``margin`` are the same moment; pauses: possible build-ups; lengths (by, length): ``quotas`` hold for a
    length of ``per`` and are scaled by the recording's, by a half at least.

    seeds: by, seed_no in time order, lane, strength (1 at most), t_ini, t_fin, phrases, members, build_up.
    refused: by, id, lane, t_ini, t_fin, rank, why."""
    single = F.array(F.struct("t_peak", F.col("id").cast("string").alias("id"), "modality", "value", "rank"))
    one = lambda df, lane, always: df.select(*by, F.col("id").cast("string").alias("id"), lane.alias("lane"), "t_ini", "t_fin", "t_peak", "rank", single.alias("members"), F.lit(always).alias("always"))
    rows = nuclei(pool, by, near).withColumn("always", F.lit(False)).unionByName(one(pool, F.col("modality"), False)).unionByName(one(orders, F.col("modality"), True))
    rows = stored(rows, "index")
    wide = rows.select(*by, "id", "always", (F.col("t_ini") - F.lit(margin)).alias("l_ini"), (F.col("t_fin") + F.lit(margin)).alias("l_fin"))
    touched = overlap_join(apart(wide), phrases.select(*by, F.col("id").cast("string").alias("phrase"), F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin")), by, ("l_ini", "l_fin"), convention=Convention.OPEN, bin_width=bin_width)
    touched = touched.groupBy(*by, "id", "always").agg(F.array_sort(F.collect_set("phrase")).alias("phrases"))
    rows = rows.join(apart(touched), [*by, "id", "always"], "left").withColumn("phrases", F.coalesce("phrases", F.array().cast("array<string>")))
    rows = stored(rows, "index")
    scale = lengths.select(*by, F.greatest(F.col("length") / F.lit(per), F.lit(0.5)).alias("scale"))
    chosen = stored(quota_select(rows, by, "lane", "rank", [MULTIMODAL, *lanes], quotas, spacing, "always", "phrases", scale, bin_width), "index")
    led = build_ups(rows.select(*by, "id", "t_peak").distinct(), pauses, by, reach)
    taken = chosen.where("accepted").select(*by, "id", "lane").join(rows, [*by, "id", "lane"]).join(led, [*by, "id"], "left")
    line = Window.partitionBy(*by).orderBy("t_ini", "id", "lane")
    seeds = taken.select(*by, F.row_number().over(line).alias("seed_no"), "id", "lane", F.round(F.least("rank", F.lit(1.0)), 2).alias("strength"), "t_ini", "t_fin", "phrases", "members", "build_up")
    return seeds, chosen.where("NOT accepted").select(*by, "id", "lane", "t_ini", "t_fin", "rank", "why")
