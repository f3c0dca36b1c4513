"""Exact duplicates by an extendible-hash index on shared files.

The index holds each distinct 64-bit key once, with its number of rows. Its directory takes the
leading bits of a key: it starts with one bucket, and as long as a bucket holds more keys than
CAPACITY that bucket is split by its next bit; where it has used all bits of the directory, the
directory doubles first. So a bucket is a range of keys, and its owner task meets all rows of
that range. At MAX_DEPTH bits a bucket stays overfull, which costs time and nothing else.

1. Keys are counted (combined before the shuffle), the directory is grown from the histogram of
   their leading MAX_DEPTH bits, and the index is written in key order to the shared folder.
2. The keys of several rows become a bit filter of bounded size. A row whose bit is not set is
   alone with its text and ends in the scan that reads it. Only the other texts travel, once.
3. An owner task walks through its rows in key order. Rows of a key form chains: a row joins the
   first chain whose text has the same bytes, or begins one. So keys that collide never merge
   different texts. A frequent key is dealt into pages of about PAGE rows, whose chains are
   compared page by page, FAN pages at a time, until one is left.

Keys are frequent from the larger of PAGE and a 65,536th of all rows on, so at most 65,536 of them
are broadcast, whatever the input. No group of copies meets in one task; a task holds the distinct
texts of one key in one page, which is one text unless keys collide.

Defined results: a null text counts as empty, and all empty texts are one group; texts are equal
when their bytes are, white space and case included; the largest id of a group stays, a null id
only where there is no other; of several rows with that id and text exactly one is kept; ids may
have any type that can be ordered; empty table, empty result; other columns are ignored, whatever
their names. ``docs`` must give the same rows each time that it is read: save it first otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, slices, table

#: Keys of a bucket before it is split, most bits of the directory, rows of a page of a frequent
#: key, pages whose chains are compared at once, most keys that are broadcast, most bits of the filter.
CAPACITY, MAX_DEPTH, PAGE, FAN, FREQUENT, FILTER_BITS = 256, 16, 256, 256, 1 << 16, 25


@dataclass
class Directory:
    """slots[i] is the bucket of the keys that begin with the bits of i; local[b] are the bits bucket b uses."""

    slots: np.ndarray
    local: np.ndarray

    @property
    def depth(self) -> int:
        return len(self.slots).bit_length() - 1


def grown(load: np.ndarray, directory: Directory | None = None, capacity: int = CAPACITY) -> Directory:
    """The directory after all overfull buckets were split; ``load`` has the keys by their leading
    bits, in 2**k entries. A given directory keeps its splits, as when keys were added."""
    most = len(load).bit_length() - 1
    slots, local = (directory.slots.copy(), directory.local.copy()) if directory else (np.zeros(1, np.int64), np.zeros(1, np.int64))
    while True:
        fill = np.bincount(slots, load.reshape(len(slots), -1).sum(1), len(local))
        over = (fill > capacity) & (local < most)
        if not over.any():
            return Directory(slots, local)
        if (local[over] == len(slots).bit_length() - 1).any():
            slots = np.repeat(slots, 2)
        first, width = np.unique(slots, return_index=True)[1], np.bincount(slots)
        upper = over[slots] & (np.arange(len(slots)) - first[slots] >= width[slots] // 2)
        slots[upper] = (np.cumsum(over) + len(local) - 1)[slots[upper]]
        local[over] += 1
        local = np.concatenate([local, local[over]])


@dataclass
class Index:
    """The index on shared files: (bucket, key, n) in key order, its directory and the rows counted."""

    entries: DataFrame
    directory: Directory
    rows: int

    def bucket(self, rows: DataFrame) -> DataFrame:
        """Adds the bucket of each key; the directory has at most 2**MAX_DEPTH slots."""
        slots = self.directory.slots
        at = rows.sparkSession.createDataFrame(pa.table({"slot": pa.array(np.arange(len(slots)), pa.int64()), "bucket": pa.array(slots, pa.int64())}))
        return rows.withColumn("slot", _leading(self.directory.depth)).join(F.broadcast(at), "slot").drop("slot")


def _leading(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")


def keyed(docs: DataFrame, id_col: str, text_col: str, hashed: Callable[[Column], Column]) -> DataFrame:
    """id, bytes of the whole text, key and a number of the row."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), body.alias("body"), hashed(body).cast("long").alias("key"), F.monotonically_increasing_id().alias("row"))


def build(rows: DataFrame) -> Index:
    """The index of the column ``key``."""
    counts = save(rows.groupBy("key").agg(F.count("*").alias("n")))
    found = counts.groupBy(_leading(MAX_DEPTH).alias("at")).agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).toPandas()
    load = np.zeros(1 << MAX_DEPTH, np.int64)
    load[found["at"].to_numpy(np.int64)] = found["keys"]
    index = Index(counts, grown(load), int(found["rows"].sum()))
    index.entries = save(index.bucket(counts).repartition("bucket").sortWithinPartitions("bucket", "key"))
    return index


def chained(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Owner tasks: rows of the same (bucket, key, page) get the number of their chain and their
    place; a chain's first row carries the text on where ``more`` says that other pages follow."""
    kept = [rows.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "chain long, place long, sha string, body binary"])

    def run(batches):
        at, chain, n = None, {}, 0
        for b in slices(batches):
            chains, places, shas, heads = [], [], [], []
            for key, page, more, body in zip(*(b[c].to_pylist() for c in ("key", "page", "more", "body")), strict=True):
                if (key, page) != at:
                    at, chain, n = (key, page), {}, 0
                first = body not in chain  # a dictionary compares whole texts
                if first:
                    chain[body] = (len(chain), hashlib.sha256(body).hexdigest())
                link, sha = chain[body]
                chains.append(link)
                places.append(n)
                shas.append(sha)
                heads.append(body if first and more else None)
                n += 1
            own = [pa.array(chains, pa.int64()), pa.array(places, pa.int64()), pa.array(shas, pa.string()), pa.array(heads, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *own], [*keep, "chain", "place", "sha", "body"])

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(partitions, "bucket", "page").sortWithinPartitions("bucket", "key", "page")
    return save(dealt.mapInArrow(run, schema))


def merged(heads: DataFrame, pages: int) -> DataFrame:
    """(key, page, chain, whole) of the chains of frequent keys: whole is the chain of the key.

    heads: bucket, key, page, chain, body, one row a chain. Pages are compared FAN at a time."""
    via = heads.select("key", "page", "chain", F.col("page").alias("p"), F.col("chain").alias("c"))
    while pages > 1:
        pages = -(-pages // FAN)
        level = heads.select("bucket", "key", F.col("page").alias("p"), F.col("chain").alias("c"), F.expr(f"page div {FAN}").alias("page"), F.lit(pages > 1).alias("more"), "body")
        out = chained(level, ["bucket", "key", "page", "p", "c"])
        step = out.select("key", "p", "c", F.col("page").alias("p2"), F.col("chain").alias("c2"))
        via = via.join(step, ["key", "p", "c"]).select("key", "page", "chain", F.col("p2").alias("p"), F.col("c2").alias("c"))
        heads = out.where("body IS NOT NULL").select("bucket", "key", "page", "chain", "body")
    return via.select("key", "page", "chain", F.col("c").alias("whole"))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``."""
    rows = keyed(docs, id_col, text_col, hashed)
    index = build(rows.select("key"))
    several = index.entries.where("n > 1")
    bits = min(FILTER_BITS, max(16, (8 * several.count()).bit_length()))
    bit = F.shiftrightunsigned(F.xxhash64("key", F.lit(1)), 64 - bits)
    words = several.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    marked = rows.withColumn("bit", bit).withColumn("word", F.shiftright("bit", 6)).join(F.broadcast(words), "word", "left")
    copied = F.coalesce(F.expr("(shiftright(mask, cast(bit & 63 as int)) & 1) = 1"), F.lit(False))
    alone = marked.where(~copied).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2("body", 256).alias("text_sha256"))

    # fewer than FREQUENT keys can have more than a FREQUENT-th of all rows each
    frequent = several.where(F.col("n") > max(PAGE, index.rows // FREQUENT)).select("key", F.ceil(F.col("n") / PAGE).alias("pages"))
    pages = frequent.agg(F.max("pages")).first()[0] or 1
    dealt = index.bucket(marked.where(copied).drop("word", "mask", "bit")).join(F.broadcast(frequent), "key", "left")
    page = F.when(F.col("pages") > 1, F.pmod(F.xxhash64("row"), F.col("pages"))).otherwise(F.lit(0).cast("long"))
    found = chained(dealt.select("doc_id", "bucket", "key", page.alias("page"), F.coalesce(F.col("pages") > 1, F.lit(False)).alias("more"), "body"), ["doc_id", "bucket", "key", "page", "more"])
    whole = merged(found.where("body IS NOT NULL").select("bucket", "key", "page", "chain", "body"), pages)
    named = ["doc_id", "key", "page", "place", "sha"]
    classes = found.where("NOT more").select(*named, F.col("chain").alias("whole")).unionByName(found.where("more").join(whole, ["key", "page", "chain"]).select(*named, "whole"))
    groups = classes.groupBy("key", "whole").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "page", "place")).alias("stays"))
    kept = (F.col("page") == F.col("stays.page")) & (F.col("place") == F.col("stays.place"))
    # by page, so that the rows of a frequent text are not joined in one task
    groups = classes.select("key", "whole", "page").distinct().join(groups, ["key", "whole"])
    copies = classes.join(groups, ["key", "whole", "page"]).select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(copies)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents", "doc_id", "text"))


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
