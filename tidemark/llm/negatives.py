"""Hard negatives by inverted lists of k-means clusters with stored radii.

Each component becomes floor(256 * c), so scores are exact whole numbers. A bounded sample gives
the centroids; every row joins the list of its nearest one, and per list the rows, the radius
(the largest distance from the centroid) and nothing else is kept, at most CLUSTERS of them. By
Cauchy-Schwarz a row of a list scores between a.m - |a| r and a.m + |a| r with the anchor a.

An anchor visits lists by falling upper bound, in waves of 2, 16, 128 ... lists. It looks for the
best rows of one or several windows of scores. A list is skipped where its bounds lie outside all
windows, or where its upper bound is strictly below the kth score of every window that it reaches; an anchor stops when no
list is left whose bound reaches. Two searches of this kind make the result: the positives of an
anchor (rows of its label, one window of all scores), then its negatives (rows of other labels,
one window for each positive, set by the positive's score).

Lists are dealt into chunks, and anchors into groups, of bounded size, so a list with a third of
all rows is many tasks. Per (group, chunk) one task gets the anchors that visit and the chunk's
rows, and returns the best few of each window. Embeddings without clusters can't be pruned by any
bound: then every list is visited and the work is that of all (anchor, row) pairs, in blocks.

Defined results: rows whose label or vector is null, or whose vector holds a null or a component
that is not finite, and rows with a null id take no part; shorter vectors count as padded with
zeros; an anchor's other rows are those with another id; ties go to the smaller id; fewer rows
than asked give fewer; a positive with a score below zero has an empty window; of repeated ids
each row is a candidate, a positive and an anchor of its own; scores beyond a long are cut to its limits; empty
table, empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, slices, table
from .knn import k_means, nearest
from .vectors import EXACT, LONGEST, complete, floored, matrix

SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 100, 5, 5, 80, 100
#: Most clusters, rows of a cluster aimed at, most rows of a chunk or a group of anchors and most
#: numbers held by one, numbers of a batch, lists of the first wave, growth of a wave.
CLUSTERS, CLUSTER_ROWS, MOST_ROWS, NUMBERS, BATCH, WAVE, GROWTH = 1024, 2048, 8192, 1 << 20, 1 << 18, 2, 8
WINDOWS = "array<struct<w:int,lo:long,hi:long,kth:long>>"
FOUND = "anchor_row long, w int, vec_id long, score long"


@dataclass
class Clusters:
    """What is known of the inverted lists."""

    centroids: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    first: np.ndarray
    width: int

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and cluster scores that no row passes, below and above."""
        with np.errstate(over="ignore", invalid="ignore"):
            dot, size = a @ self.centroids.T, np.linalg.norm(a, axis=1)[:, None]
            slack = size * self.radius + 1 + 1e-9 * size * (np.linalg.norm(self.centroids, axis=1) + self.radius)  # rounding
            low, high = dot - slack, dot + slack
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def lists_of(rows: DataFrame) -> tuple[DataFrame, Clusters] | None:
    """The inverted lists of (vec_id, label, v): rows with their chunk, and the clusters."""
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return None
    width = max(1, width)
    step = max(1, BATCH // width)
    k = int(max(1, min(CLUSTERS, BATCH // width, max(16, n // CLUSTER_ROWS))))
    sample = rows.orderBy(F.xxhash64("v", "vec_id")).limit(16 * k).select("v").toArrow()
    centroids = k_means(matrix(sample["v"], width), k)

    def run(batches):
        for b in slices(batches, step):
            cluster, far = nearest(matrix(b["v"], width), centroids)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["v"], pa.array(cluster), pa.array(far)], ["vec_id", "label", "v", "cluster", "far"])

    kind = rows.schema["label"].dataType.simpleString()
    placed = save(rows.mapInArrow(run, f"vec_id long, label {kind}, v array<double>, cluster int, far double").withColumn("row", F.monotonically_increasing_id()))
    known = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.max("far").alias("radius")).orderBy("cluster").toPandas()  # CLUSTERS rows
    size, most = known["n"].to_numpy(np.int64), max(1, min(MOST_ROWS, NUMBERS // width))
    parts = -(-size // most)
    first = np.cumsum(parts) - parts
    slot = {int(c): i for i, c in enumerate(known["cluster"])}
    at = F.array(*[F.lit(slot.get(c, 0)) for c in range(len(centroids))])[F.col("cluster")]
    begin, deal = (F.array(*map(F.lit, x.tolist()))[at] for x in (first, parts))
    rows = placed.select("vec_id", "label", "v", "row", (begin + F.pmod(F.xxhash64("row"), deal)).cast("int").alias("chunk"))
    # what is longer than the largest distance seen, by rounding, is still inside
    return rows, Clusters(centroids[known["cluster"].to_numpy()], known["radius"].to_numpy() * (1 + 1e-9), parts, first, width)


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    if np.linalg.norm(a, axis=1).max() * np.linalg.norm(x, axis=1).max() < EXACT:
        return (a @ x.T).astype(np.int64)
    a, x = (np.frompyfunc(int, 1, 1)(m) for m in (a, x))
    return np.clip(a @ x.T, -LONGEST - 1, LONGEST).astype(np.int64)


def _best(k: int, same: bool, width: int):
    """The k best rows of a chunk in each window of each anchor of a group."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor_row": [], "w": [], "vec_id": [], "score": []}
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("vec_id")
            ids, labels, x = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["v"], width)
            step = max(1, 4 * NUMBERS // len(ids))
            for s in range(0, anchors.num_rows, step):
                some = anchors.slice(s, step)
                own = zip(*(some[c].to_pylist() for c in ("anchor_row", "anchor_id", "anchor_label", "windows")), strict=True)
                for (row, anchor, label, windows), line in zip(own, scores(matrix(some["a"], width), x), strict=True):
                    low = min(max(w["lo"], w["kth"]) for w in windows)
                    fit = np.flatnonzero(((labels == label) == same) & (line >= low) & (line <= max(w["hi"] for w in windows)) & (ids != anchor))
                    fit = fit[np.argsort(~line[fit], kind="stable")]  # ~ reverses the order of whole numbers; ids stay in order
                    for w in windows:
                        there = fit[(line[fit] <= w["hi"]) & (line[fit] >= max(w["lo"], w["kth"]))][:k]
                        out["anchor_row"] += [row] * len(there)
                        out["w"] += [w["w"]] * len(there)
                        out["vec_id"] += ids[there].tolist()
                        out["score"] += line[there].tolist()
        return pa.table({c: pa.array(v, pa.int32() if c == "w" else pa.int64()) for c, v in out.items()})

    return run


def search(anchors: DataFrame, lists: DataFrame, clusters: Clusters, same: bool, k: int) -> DataFrame:
    """(anchor_row, w, rank, vec_id, score) of the k best rows of each window among the rows that
    have the anchor's label, or have not.

    anchors: saved rows of anchor_row, anchor_id, anchor_label, a, grp and windows (w, lo, hi)."""
    step, width, begin, best = max(1, BATCH // max(clusters.width, len(clusters.radius))), clusters.width, 0, None
    rank = Window.partitionBy("anchor_row", "w").orderBy(F.desc("score"), "vec_id", "tie")
    label = anchors.schema["anchor_label"].dataType.simpleString()
    visit = f"anchor_row long, anchor_id long, anchor_label {label}, a array<double>, windows {WINDOWS}, grp int, chunk int"
    while begin < len(clusters.radius):
        end = begin + (WAVE if not begin else begin * (GROWTH - 1))

        def visits(batches, begin=begin, end=end):
            """The chunks of the lists of this wave that a window still needs."""
            for b in slices(batches, step):
                low, high = clusters.bounds(matrix(b["a"], width))
                at, chunk = [], []
                for i, windows in enumerate(b["windows"].to_pylist()):
                    for c in np.argsort(-high[i], kind="stable")[begin:end]:
                        if any(high[i, c] >= max(w["lo"], w["kth"]) and low[i, c] <= w["hi"] for w in windows):
                            at += [i] * int(clusters.parts[c])
                            chunk += range(clusters.first[c], clusters.first[c] + clusters.parts[c])
                out = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(out[c] for c in ("anchor_row", "anchor_id", "anchor_label", "a", "windows", "grp")), pa.array(chunk, pa.int32())], [*out.schema.names[:6], "chunk"])

        open_windows = _with_kth(anchors, best, k)
        asked = save(open_windows.select("anchor_row", "anchor_id", "anchor_label", "a", "windows", "grp").mapInArrow(visits, visit))
        pairs = asked.select(F.col("grp").alias("to"), F.col("chunk").alias("part")).distinct()
        sent = lists.join(pairs, lists["chunk"] == pairs["part"]).select("vec_id", "label", "v", "to", "part")
        found = asked.groupBy("grp", "chunk").cogroup(sent.groupBy("to", "part")).applyInArrow(_best(k, same, width), FOUND).withColumn("tie", F.lit(0))
        every = found if best is None else found.unionByName(best.select("anchor_row", "w", "vec_id", "score", F.col("rank").alias("tie")))
        best = save(every.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("anchor_row", "w", "rank", "vec_id", "score"))
        begin = end
    return best


def _with_kth(anchors: DataFrame, best: DataFrame | None, k: int) -> DataFrame:
    """Each window with the kth score found for it so far."""
    lowest = F.lit(-LONGEST - 1)
    if best is None:
        return anchors.withColumn("windows", F.transform("windows", lambda w: F.struct(w["w"].alias("w"), w["lo"].alias("lo"), w["hi"].alias("hi"), lowest.alias("kth"))))
    reached = best.where(F.col("rank") == k).groupBy("anchor_row").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("reached"))  # a row a window
    kth = lambda w: F.coalesce(F.element_at("reached", w["w"]), lowest)
    return anchors.join(reached, "anchor_row", "left").withColumn("windows", F.transform("windows", lambda w: F.struct(w["w"].alias("w"), w["lo"].alias("lo"), w["hi"].alias("hi"), kth(w).alias("kth"))))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding", scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor
    and each of its best ``positives`` rows of the same label the best ``negatives`` rows of other
    labels that score between ``low`` and ``high`` percent of the positive. ``is_anchor`` is a condition on the column vec_id."""
    label, v = F.col(label_col) if isinstance(label_col, str) else label_col, F.col(vector_col)
    rows = vectors.where(complete(v) & label.isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), floored(v, scale).alias("v"))
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    made = lists_of(rows)
    nothing = vectors.sparkSession.createDataFrame([], names)
    if made is None:
        return nothing
    lists, clusters = made
    anchors = lists.where(is_anchor)
    n = anchors.count()
    if not n:
        return nothing
    groups = -(-n // max(1, min(MOST_ROWS, NUMBERS // clusters.width)))
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    anchors = save(anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("v").alias("a"), group.alias("grp")))
    window = lambda w, lo, hi: F.struct(F.lit(w).cast("int").alias("w") if isinstance(w, int) else w.alias("w"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    everything = F.array(window(0, F.lit(-LONGEST - 1), F.lit(LONGEST)))
    close = search(anchors.withColumn("windows", everything), lists, clusters, True, positives)

    score = F.col("score").cast("decimal(20,0)")
    reach = window(F.col("rank"), F.ceil(score * low / 100), F.least(F.floor(score * high / 100), F.lit(LONGEST)))
    wanted = close.where("score >= 0").groupBy("anchor_row").agg(F.collect_list(reach).alias("windows"))  # at most ``positives``
    far = search(save(anchors.join(wanted, "anchor_row")), lists, clusters, False, negatives)
    pair = close.select("anchor_row", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = far.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pair, ["anchor_row", "w"]).join(anchors.select("anchor_row", "anchor_id"), "anchor_row")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), F.col("vec_id") % EVERY == 0, label_col=label)


OP11_SQL = """
WITH x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_inner_product(a.v, x.v)::BIGINT AS score
      FROM x a JOIN x ON a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""
