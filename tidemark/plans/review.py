"""Larger compositions: the master of a conversation, the view of a finished cut, voice gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import conversation as cv
from ..operators import intervals as iv
from ..operators import remap as rm
from ..operators import stats as st
from ..operators.joins import overlap_join


def conversation_master(utterances: DataFrame, by: list[str], track: str, id_col: str, text: str, quality: list[str], bin_width=None) -> dict[str, DataFrame]:
    """Utterances, overlap groups, duplicates heard on two tracks, and the utterances without them."""
    normal = utterances.withColumn("__body", tx.normalized(F.col(text)))
    duplicates = cv.bleed_duplicates(normal, by, track, id_col, "__body", quality, bin_width=bin_width)
    clean = utterances.join(duplicates.select(*by, F.col("secondary_id").alias(id_col)), [*by, id_col], "left_anti")
    return {"utterances": utterances, "overlap_groups": cv.overlap_groups(utterances, by, track, id_col), "duplicates": duplicates, "clean": clean}


def cut_view(events: DataFrame, mapping: DataFrame, by: list[str], stream: str, id_col: str, value: str, step, bin_width=None) -> dict[str, DataFrame]:
    """What a finished cut looks like on its own clock: its events with values normalised anew,
    the junctions, and the intensity of every ``step``."""
    moved = rm.derive(events, mapping, by, id_col, bin_width)
    z = st.robust_z(moved, [*by, stream], value)
    return {"events": z, "junctions": rm.junctions(mapping, by), "curve": st.curve(z.withColumn("__a", F.abs(f"{value}_rz")), by, "__a", step)}


def gate_gaps(words: DataFrame, by: list[str], bounds: DataFrame, mode: str, active: DataFrame | None = None, breaths: DataFrame | None = None, pad=0, shrink=0, min_gap=0, merge=0) -> DataFrame:
    """Where a gate may close: outside padded words (``words``), outside voice activity
    (``activity``), or on breaths but never inside a word (``breaths``, with a breath_id)."""
    if mode == "activity":
        return iv.complement(iv.speech_from_activity(active, words, by, merge), by, bounds, min_gap).select(*by, "t_ini", "t_fin")
    if mode == "breaths":
        return iv.shielded(breaths, words, by, "breath_id", shrink, min_gap).where("t_ini is not null").select(*by, "t_ini", "t_fin")
    padded = words.select(*by, (F.col("t_ini") - F.lit(pad)).alias("t_ini"), (F.col("t_fin") + F.lit(pad)).alias("t_fin"))
    return iv.kept_segments(padded, by, bounds, min_gap)


def labels_at(ranges: DataFrame, topics: DataFrame, by: list[str], id_col: str, label: str, bin_width=None) -> DataFrame:
    """The labels of all topics that overlap each range, in time order."""
    t = topics.select(*by, F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"), label)
    hit = overlap_join(ranges.select(*by, id_col, "t_ini", "t_fin"), t, by, bin_width=bin_width)
    names = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("r_ini", label))), lambda x: x[label])), ", ")
    found = hit.groupBy(*by, id_col).agg(names.alias("labels"))
    return ranges.select(*by, id_col).join(found, [*by, id_col], "left").withColumn("labels", F.coalesce("labels", F.lit("")))


def text_inside(ranges: DataFrame, words: DataFrame, by: list[str], id_col: str, text: str, whole: bool, bin_width=None) -> DataFrame:
    """The words of each range in order: those that overlap it, or (``whole``) lie inside it."""
    w = words.select(*by, F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"), text)
    hit = overlap_join(ranges.select(*by, id_col, "t_ini", "t_fin"), w, by, bin_width=bin_width)
    if whole:
        hit = hit.where((F.col("r_ini") >= F.col("t_ini")) & (F.col("r_fin") <= F.col("t_fin")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_ini", "r_fin", text))), lambda x: x[text]), " ")
    return ranges.select(*by, id_col).join(hit.groupBy(*by, id_col).agg(said.alias("said"), F.count("*").alias("n")), [*by, id_col], "left")


def timeline_xml(pieces: DataFrame, by: list[str], fps: int) -> DataFrame:
    """One clip element for each piece of a flattened sequence, times as frame fractions."""
    def frames(c):
        return F.concat(F.floor((F.col(c) * fps + 500) / 1000).cast("string"), F.lit(f"/{fps}s"))

    size = F.concat(F.floor(((F.col("source_fin") - F.col("source_ini")) * fps + 500) / 1000).cast("string"), F.lit(f"/{fps}s"))
    element = F.concat(F.lit('<asset-clip ref="r1" offset="'), frames("seq_ini"), F.lit('" start="'), frames("source_ini"), F.lit('" duration="'), size, F.lit('"/>'))
    return pieces.select(*by, "pos", element.alias("element"))


def montage_lines(utterances: DataFrame, topics: DataFrame, by: list[str]) -> DataFrame:
    """The transcript with the topics' beginnings and ends between the lines: (by, line_no, t, line).

    utterances: id, t_ini, t_fin, track, text; topics: item_id, label, parent_id, t_ini, t_fin, one row for each range. At
    one time ends of topics come after utterances, beginnings before."""
    from ..functions.time import format_ms
    from ..operators.documents import depth

    items = depth(topics.select(*by, "item_id", "parent_id").distinct(), by, "item_id", "parent_id").select(*by, "item_id", F.when(F.col("depth") > 0, "Subtopic").otherwise("Topic").alias("kind"))
    part = Window.partitionBy(*by, "item_id")
    named = topics.withColumn("part", F.row_number().over(part.orderBy("t_ini", "t_fin"))).withColumn("parts", F.count("*").over(part)).join(items, [*by, "item_id"])
    piece = F.when(F.col("parts") > 1, F.format_string(" · part %d/%d", "part", "parts")).otherwise("")
    opens = named.select(*by, F.col("t_ini").alias("t"), F.lit(0).alias("place"), F.col("item_id").cast("string").alias("id"), F.concat(F.lit("## > "), "kind", F.lit(": "), "label", F.lit(" ("), F.col("item_id").cast("string"), F.lit(")"), piece).alias("line"))
    ends = named.select(*by, F.col("t_fin").alias("t"), F.lit(2).alias("place"), F.col("item_id").cast("string").alias("id"), F.concat(F.lit("## < end: "), "label", F.lit(" ("), F.col("item_id").cast("string"), F.lit(")")).alias("line"))
    said = F.concat(format_ms(F.col("t_ini")), F.lit("–"), format_ms(F.col("t_fin")), F.lit(" ["), "track", F.lit("] "), F.coalesce("text", F.lit("")))
    talk = utterances.select(*by, F.col("t_ini").alias("t"), F.lit(1).alias("place"), F.col("id").cast("string").alias("id"), said.alias("line"))
    line = Window.partitionBy(*by).orderBy("t", "place", "id", "line")
    return opens.unionByName(talk).unionByName(ends).select(*by, F.row_number().over(line).alias("line_no"), "t", "line")


def annotated_lines(phrases: DataFrame, events: DataFrame, by: list[str], bounds: DataFrame, least_gap, quiet_lanes: tuple[str, ...] = (), bin_width=None) -> DataFrame:
    """Phrases with the highest tier of each lane that is active in them, and gaps of at least ``least_gap`` in which something
    happens: a lane of ``quiet_lanes`` at all, another at tier 2. (by, t_ini, t_fin, kind, id, text, tiers)

    phrases: id, t_ini, t_fin, text; events: lane, tier, t_ini, t_fin; bounds: hi, the end of the last gap."""
    w = Window.partitionBy(*by).orderBy("t_ini", "t_fin", "id").rowsBetween(Window.unboundedPreceding, -1)
    gaps = phrases.withColumn("from", F.coalesce(F.max("t_fin").over(w), F.lit(0))).select(*by, F.col("from").alias("a"), F.col("t_ini").alias("b"))
    last = bounds.join(phrases.groupBy(*by).agg(F.max("t_fin").alias("end")), by, "left").select(*by, F.coalesce("end", F.lit(0)).alias("a"), F.col("hi").alias("b"))
    gaps = gaps.unionByName(last).where(F.col("b") - F.col("a") >= F.lit(least_gap)).distinct()
    rows = phrases.select(*by, "t_ini", "t_fin", F.lit("phrase").alias("kind"), F.col("id").cast("string").alias("id"), "text")
    rows = rows.unionByName(gaps.select(*by, F.col("a").alias("t_ini"), F.col("b").alias("t_fin"), F.lit("gap").alias("kind"), F.lit("").alias("id"), F.lit("").alias("text")))
    hit = overlap_join(rows, events.select(*by, "lane", "tier", F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin")), by, bin_width=bin_width)
    best = hit.where("tier > 0").groupBy(*by, "t_ini", "t_fin", "kind", "id", "lane").agg(F.max("tier").alias("tier"))
    loud = (F.col("tier") >= 2) | (F.col("lane").isin(*quiet_lanes) if quiet_lanes else F.lit(False))
    tiers = best.groupBy(*by, "t_ini", "t_fin", "kind", "id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("lane", F.lit(":"), F.col("tier").cast("string")))), " ").alias("tiers"), F.max(loud).alias("loud"))
    out = rows.join(tiers, [*by, "t_ini", "t_fin", "kind", "id"], "left").where("kind = 'phrase' OR loud")
    return out.select(*by, "t_ini", "t_fin", "kind", "id", "text", F.coalesce("tiers", F.lit("")).alias("tiers"))


def author_ledger(marks: DataFrame, spoken: DataFrame, by: list[str], bin_width=None) -> DataFrame:
    """What the author asked for, in order: marks with their rule, what is included and excluded at once (excluding wins, and
    the author is told), and spoken orders, whose own time is excluded: (by, line_no, section, t_ini, t_fin, ids, rule).

    marks: id, decision (include, exclude or null), t_ini, t_fin; spoken: id, t_ini, t_fin."""
    rule = F.when(F.col("decision") == "include", "must be in").when(F.col("decision") == "exclude", "must not be in").otherwise("note")
    first = marks.select(*by, F.lit(1).alias("section"), "t_ini", "t_fin", F.col("id").cast("string").alias("ids"), rule.alias("rule"))
    keep = marks.where("decision = 'include'").select(*by, F.col("id").cast("string").alias("i"), "t_ini", "t_fin")
    drop = marks.where("decision = 'exclude'").select(*by, F.col("id").cast("string").alias("x"), F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"))
    both = overlap_join(keep, drop, by, bin_width=bin_width).select(*by, F.lit(2).alias("section"), F.greatest("t_ini", "r_ini").alias("t_ini"), F.least("t_fin", "r_fin").alias("t_fin"), F.concat("i", F.lit("&"), "x").alias("ids"), F.lit("conflict: exclude wins").alias("rule"))
    last = spoken.select(*by, F.lit(3).alias("section"), "t_ini", "t_fin", F.col("id").cast("string").alias("ids"), F.lit("spoken: its time is out").alias("rule"))
    line = Window.partitionBy(*by).orderBy("section", "t_ini", "t_fin", "ids")
    return first.unionByName(both).unionByName(last).select(*by, F.row_number().over(line).alias("line_no"), "section", "t_ini", "t_fin", "ids", "rule")


def bundle(views: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Several views of the same recordings as one table of lines: (by, view, line_no, line). A view without lines of
    a recording has no part in its bundle."""
    out = None
    for name, lines in views.items():
        part = lines.select(*by, F.lit(name).alias("view"), F.col("line_no").cast("long").alias("line_no"), F.coalesce(F.col("line").cast("string"), F.lit("")).alias("line"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("a bundle needs a view")
    return out


def write_bundle(lines: DataFrame, root: str, revision: int, by: list[str]) -> str:
    """Writes a bundle as text, one folder a recording and view, in one job below a folder of its revision: it shows
    when it is complete, and the revision before stays as it is. Lines are dealt by ranges, so a long view
    is several files whose names are in the order of its lines."""
    path = f"{root}/revision={revision}"
    placed = lines.repartitionByRange(*by, "view", "line_no").sortWithinPartitions(*by, "view", "line_no")
    placed.drop("line_no").write.mode("errorifexists").partitionBy(*by, "view").text(path)
    return path
