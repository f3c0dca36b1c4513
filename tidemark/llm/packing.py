"""Packing of texts into padded batches.

The lengths of all documents are counted into one global histogram; dynamic programming over
it chooses the bucket boundaries that minimise the padding (every document is padded to its
bucket's boundary, the largest length in it). The histogram is exact: d different lengths need
d * d / 2 tokens of text at least, so it has some thousands of rows, and a few millions at 100 TB.
Inside each bucket documents form batches whose padded size keeps to the token budget. A bucket
that holds any share of the documents is split into shards by a hash of the id, and a shard of
many equal ids once more, so that no task orders an unbounded group; each shard leaves at most
one batch part full.

Defined results: length is the number of words (runs of characters other than white space), or
the given column of token counts (null: 0); a null or empty text has length 0 and is packed too; a document longer than the budget is a
batch of its own, whole; rows with a null id, and repeated ids, are packed as rows of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, table

BUCKETS, TOKEN_BUDGET = 16, 16_384
#: Documents that one task puts in order, about.
SHARD_DOCS = 20_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    With D and T the documents and tokens up to a length, a bucket from i to j pads
    lengths[j] * (D[j] - D[i]) - (T[j] - T[i]). For each number of buckets the best i for every j
    lies on the lower hull of the lines (best[i] + T[i]) - D[i] * x at x = lengths[j], which grows
    with j: time linear in the histogram for each bucket, in whole numbers."""
    order = np.argsort(lengths)
    sizes, n_docs = ([int(x) for x in np.asarray(v)[order]] for v in (lengths, counts))
    n = len(sizes)
    if n == 0:
        return []
    docs, tokens = [0], [0]
    for length, count in zip(sizes, n_docs, strict=True):
        docs.append(docs[-1] + count)
        tokens.append(tokens[-1] + count * length)
    best: list[int | None] = [0] + [None] * n
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut, hull, at = [None] * (n + 1), [0] * (n + 1), [], 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:  # a line more: its slope is the least so far
                line = (-docs[j - 1], best[j - 1] + tokens[j - 1], j - 1)
                while len(hull) - at >= 2 and _hidden(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            x = sizes[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            if at < len(hull):
                slope, base, cut[j] = hull[at]
                new[j] = slope * x + base + x * docs[j] - tokens[j]
        best = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        out.append(sizes[j - 1])
        j = cut[j]
    return out[::-1]


def _hidden(a: tuple, b: tuple, c: tuple) -> bool:
    """Is line b nowhere below both a and c? Slopes fall from a to c."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, tokens_col: str | None = None) -> DataFrame:
    """One row per document: id, n_tokens, bucket_len, batch_id, slot (from 0), batch_docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.size(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+"))
    n = F.coalesce(F.col(tokens_col), F.lit(0)) if tokens_col else F.when(text.rlike(r"\S"), words).otherwise(F.lit(0))
    sized = docs.select(F.col(id_col), n.cast("long").alias("n_tokens"), F.monotonically_increasing_id().alias("__row"))
    sized = save(sized)
    counted = sized.groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas()
    lengths, counts = counted["n_tokens"].to_numpy(), counted["n"].to_numpy()
    bounds = boundaries(lengths, counts, buckets)
    if not bounds:
        return sized.select(id_col, "n_tokens", F.lit(0).cast("long").alias("bucket_len"), F.lit("").alias("batch_id"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("batch_docs"))
    level, shards = F.lit(bounds[-1]), F.lit(1)
    for low, b in reversed(list(zip([-1, *bounds], bounds, strict=False))):
        inside = int(counts[(lengths > low) & (lengths <= b)].sum())
        fits = F.col("n_tokens") <= b
        level, shards = F.when(fits, F.lit(b)).otherwise(level), F.when(fits, F.lit(max(1, -(-inside // SHARD_DOCS)))).otherwise(shards)
    dealt = sized.withColumn("bucket_len", level.cast("long")).withColumn("shard", F.pmod(F.xxhash64(id_col, "n_tokens"), shards))
    # shards grown far beyond their share by rows of equal id and length are dealt by row
    full = dealt.groupBy("bucket_len", "shard").agg(F.count("*").alias("held")).where(F.col("held") > 2 * SHARD_DOCS)
    dealt = dealt.join(F.broadcast(full), ["bucket_len", "shard"], "left")
    part = F.when(F.col("held").isNotNull(), F.pmod(F.xxhash64("__row"), F.ceil(F.col("held") / SHARD_DOCS))).otherwise(0)
    dealt = dealt.withColumn("part", part)
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    key = ["bucket_len", "shard", "part"]
    placed = dealt.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy(id_col, "n_tokens", "__row")) - 1).withColumn("per", per)
    placed = placed.withColumn("batch", F.floor(F.col("at") / F.col("per")))
    size = F.count("*").over(Window.partitionBy(*key, "batch"))
    name = F.concat_ws("-", *key, "batch")
    return placed.select(F.col(id_col), "n_tokens", "bucket_len", name.alias("batch_id"), (F.col("at") % F.col("per")).cast("int").alias("slot"), size.alias("batch_docs"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
