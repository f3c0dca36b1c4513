"""N-gram Jaccard join by a token-group matrix.

A document's set are the distinct hashed shingles of its words. Documents with equal sets are
one class. Per class a prefix of the set in one global order (frequent shingles last, then by
hash) is long enough that two linking sets share a known number of prefix shingles; ``linking``
groups similar classes, keeps each group's union of them, bounds the overlap of query and
group, and opens only groups that can hold a partner. What is opened is verified on whole texts.

The order's frequent shingles are counted over all documents; at most ``MAX_HOT`` of them
(a fixed size) are broadcast. Any order gives the same links; this one keeps groups small.

Defined results: null or empty texts, and texts of white space, have no set, n_shingles 0, and
link with nothing; a null doc_id links with nothing and has a null component; rows that
share a doc_id are one document to links, with the sets of all its rows; an empty table gives
an empty result; other columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, slices, table
from .linking import FILTER_BITS, distinct, link_components, sifted

#: A shingle in more classes' prefixes than HOT counts as frequent; at most MAX_HOT are told apart.
HOT, MAX_HOT = 8, 1_000_000
#: Bytes hashed at a time; a longer text is hashed alone.
SLICE = 1 << 19


_lower = np.arange(256, dtype=np.uint64)
_lower[65:91] += np.uint64(32)
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, grown as needed."""
    if not _powers or len(_powers[0]) < n:
        up = np.full(max(n, 2 * SLICE), BASE, np.uint64)
        down = np.full(len(up), pow(int(BASE), -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word: prefix sums of byte * BASE**i modulo 2**64, mixed."""
    codes = np.frombuffer(raw, np.uint8)
    edges = np.diff(np.concatenate([[True], _space[codes], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges < 0), np.flatnonzero(edges > 0)
    up, down = _power(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_lower[codes] + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _long_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of a long text, in slices that end between words."""
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            space = np.flatnonzero(_space[np.frombuffer(raw, np.uint8, offset=end, count=min(SLICE, len(raw) - end))])
            while not len(space) and (end := end + SLICE) < len(raw):  # one very long word
                space = np.flatnonzero(_space[np.frombuffer(raw, np.uint8, offset=end, count=min(SLICE, len(raw) - end))])
            end = end + int(space[0]) if len(space) else len(raw)
        h, s = word_hashes(raw[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles; A-Z count as a-z.

    Words end at the bytes 09-0D and 20 only. Texts are hashed together in slices."""
    out: list[np.ndarray] = []
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(encoded):
        end, total = at, 0
        while end < len(encoded) and (end == at or total + len(encoded[end]) <= SLICE):
            total += len(encoded[end]) + 1
            end += 1
        part = encoded[at:end]
        h, starts = _long_words(part[0]) if len(part) == 1 and len(part[0]) > 2 * SLICE else word_hashes(b"\n".join(part))
        borders = np.cumsum([0] + [len(p) + 1 for p in part])
        first = np.searchsorted(starts, borders)
        grams = np.full(max(0, len(h) - size + 1), size, np.uint64)
        for i in range(size):
            grams = _mixed(grams ^ h[i : len(h) - size + 1 + i]) if len(grams) else grams
        for low, high in zip(first[:-1], first[1:], strict=True):
            n = high - low
            if n >= size:
                out.append(distinct(grams[low : high - size + 1]))
            elif n:  # fewer words: the whole sequence
                x = np.full(1, n, np.uint64)
                for i in range(n):
                    x = _mixed(x ^ h[low + i : low + i + 1])
                out.append(x)
            else:
                out.append(np.empty(0, np.uint64))
        at = end
    return out


def shingles(text: str | None, size: int) -> np.ndarray:
    return shingle_sets([text], size)[0]


def need_of(n: int) -> int:
    """Prefix shingles that two linking sets must share at least, by the size of the smaller need."""
    return 1 + min(15, n // 4)


def prefix_length(n: int, percent: int) -> int:
    """Sets that link share at least need_of shingles of prefixes this long, in any one order."""
    return n - -(-n * percent // 100) + need_of(n) if n else 0


def profiles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, need, set_key, keys) of every row."""
    spark = docs.sparkSession

    def common(batches):
        for b in slices(batches):
            keys, owners = [], []
            for t in shingle_sets(b["text"].to_pylist(), size):
                p = t[: prefix_length(len(t), percent)]
                keys.append(p)
                owners.append(np.full(len(p), xxhash.xxh64_intdigest(t.tobytes()), np.uint64))
            pair = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (keys, owners)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["key", "owner"])

    seen = docs.select("text").mapInArrow(common, "key long, owner long").distinct()
    hot = seen.groupBy("key").count().where(F.col("count") > HOT).orderBy(F.desc("count"), "key").limit(MAX_HOT).select("key").toPandas()
    shared = spark.sparkContext.broadcast(np.sort(hot["key"].to_numpy(np.int64).view(np.uint64)))

    def rare_first(t: np.ndarray, length: int) -> np.ndarray:
        """The first shingles in the order (frequent, hash)."""
        frequent = shared.value
        if not len(frequent):
            return t[:length]
        for some in (t[: 2 * length + 16], t):
            at = np.minimum(np.searchsorted(frequent, some), len(frequent) - 1)
            late = frequent[at] == some
            if len(some) - np.count_nonzero(late) >= length:
                break
        return np.concatenate([some[~late], some[late]])[:length]

    def profile(batches):
        for b in slices(batches):
            n, need, key, keys = [], [], [], []
            for t in shingle_sets(b["text"].to_pylist(), size):
                n.append(len(t))
                need.append(need_of(len(t)))
                key.append(hashlib.blake2b(t.tobytes(), digest_size=16).digest() if len(t) else None)
                keys.append(rare_first(t, prefix_length(len(t), percent)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(need, pa.int32()), pa.array(key, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "need", "set_key", "keys"])

    return save(docs.mapInArrow(profile, "doc_id long, n long, need int, set_key binary, keys array<long>"))


def join_documents(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = profiles(docs, size, percent)
    classes = save(rows.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("need").alias("need")))
    one = rows.join(classes.select("set_key", "id"), "set_key").where("doc_id = id")
    keys = one.select("id", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = classes.select("id", "n", "need").distinct()  # rows of one id may hold different sets

    def texts_of(need: DataFrame) -> DataFrame:
        rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
        return sifted(rows, need, F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)))

    found = link_components(keys, sizes, texts_of, lambda texts: shingle_sets(texts, size), percent)
    merged = classes.join(found, classes["id"] == found["node"], "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(merged, "set_key", "left")
    # rows of one id may hold different sets: they share the smallest component
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that link to one of smaller id; columns as they came."""
    joined = join_documents(docs, size, percent)
    drop = joined.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
