"""Fuzzy line deduplication with MinHash.

A line's set are the hashed spans of ``span`` characters of its normalised text (lower case,
white space as one blank; a shorter line is one span). The query and the pipeline use
``SHORT_SPAN``: one replaced character changes at most 5 spans, so lines from 49 characters on
still link; with ``SPAN``, the default of the functions, only lines from 89 on. Equal normalised
lines are one item. Signatures are 60 minima in ``BANDS`` bands. Short lines have as many hash
functions and bands of ``ROWS``. Long lines have minima of one hash dealt into bins, of spans of
``SPAN`` characters (short spans are so common in long lines that most would be candidates), and
bands of ``LONG_ROWS`` to make up for it. Lines of middle length get both, so that any two lines
of Jaccard similarity 0.8 have one kind in common (length is the number of distinct spans, as in
the similarity). A short pair at the threshold is a candidate with probability 0.99, at 0.9 with
0.99998; a long one, if single characters all over the line differ, with 0.93 and 0.998.
Candidates whose sketches, one bit
of each minimum, are too far apart are dropped before any line is fetched: of lines with little in
common these are all but a hundredth. The others are tied through ``linking``, verified by exact Jaccard on the whole lines, and
distributed union-find gives the components; the line first in (doc_id, line number) stays.

Defined results: blank lines, and lines of rows with a null id, take no part and stay; a null
text has no lines; rows that share a doc_id count as one document;
empty table, empty result; other columns are passed through, whatever their names; doc_id is a whole number. ``dedup_documents``
drops a document of which no line stays, and a near copy of one other document: one whose lines are to
``PERCENT`` of the characters lines that stay in that document, if no line of it stays for a third. All other
documents keep the lines that stay, however few: what no other document holds is never lost with lines that came from several.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, save, table
from .linking import FILTER_BITS, distinct, link_components, sifted

#: Characters of a span: of the functions' default, and of the query and the pipeline.
SPAN, SHORT_SPAN = 9, 5
BANDS, ROWS, LONG_ROWS, PERCENT = 12, 5, 4, 80
#: Of the 60 bits of two lines' sketches at the threshold 6 differ on average; more than 18 do in one pair of a million.
AWAY = 18
#: Distinct spans of a line up to which minima come from many functions, and from which from one.
MANY, ONE = 160, 128
#: Spans of a long line that are looked at first to tell its kind.
HEAD = 256
#: Keys that a task packs at a time, and keys that it compares at least at a time; buckets of keys for each shuffle partition.
PACKED, BUCKETS = 1 << 18, 16
#: Characters of lines in a batch, characters hashed at a time (what a core's cache holds), ids a task remembers.
SLICE, HASHED, REMEMBER = 1 << 19, 1 << 16, 200_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Products of 32 bits are computed several at a time; equal minima of different spans are one in 2**32.
_factors = np.random.default_rng(10).integers(1, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_powers: list[np.ndarray] = []


def normalised(line: str) -> str:
    return " ".join(line.split()).lower()


def line_id(norm: str) -> int:
    """Signed 64-bit hash of a normalised line."""
    return xxhash.xxh64_intdigest(norm.encode("utf-8", "surrogatepass")) - (1 << 63)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + SPAN)
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, pow(int(BASE), -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def span_hashes(lines: list[str], span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the spans of all lines one after the other, and the first of each line.

    A span's hash comes from prefix sums of code * BASE**i modulo 2**64, and is then mixed. Lines that are no
    shorter than a span are hashed at every place of the text they make together, and the places across their borders dropped."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    spans = np.maximum(sizes - span + 1, 1)
    first = np.cumsum(spans) - spans
    short = sizes < span
    if not short.any():
        return _long_hashes("".join(lines), sizes, span), first
    out = np.empty(spans.sum(), np.uint64)
    out[np.repeat(~short, spans)] = _long_hashes("".join([x for x in lines if len(x) >= span]), sizes[~short], span)
    for n in range(span):
        at = np.flatnonzero(sizes == n)
        if len(at):
            out[first[at]] = _long_hashes("".join([lines[i] for i in at]), sizes[at], n) if n else _mix(np.zeros(len(at), np.uint64))
    return out, first


def _mix(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _long_hashes(text: str, sizes: np.ndarray, span: int) -> np.ndarray:
    """Hashes of the spans of lines of at least ``span`` characters that make up ``text``."""
    if not text:
        return np.empty(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(7)
    up, down = _power(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)], dtype=np.uint64)])
    h = _mix((sums[span:] - sums[:-span]) * down[: len(codes) - span + 1])
    whole = np.ones(len(h), bool)
    ends = np.cumsum(sizes)[:-1]
    for k in range(1, span):
        whole[ends - k] = False
    return h[whole]


def tokens(texts: list[str], span: int = SPAN) -> list[np.ndarray]:
    """Sorted distinct span hashes of normalised lines, for the exact Jaccard."""
    out: list[np.ndarray] = []
    for at in range(0, len(texts), 2000):
        h, first = span_hashes(texts[at : at + 2000], span)
        out += [distinct(x) for x in np.split(h, first[1:])]
    return out


def _bands(minima: np.ndarray, salt: int) -> np.ndarray:
    """Keys of the bands: one hash of ROWS minima and the band's number."""
    m = minima.reshape(len(minima), BANDS, -1).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1 + salt * BANDS)
    out = np.broadcast_to(key * BASE, m.shape[:2]).copy()
    for r in range(m.shape[2]):
        out = (out ^ m[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _sketch(minima: np.ndarray) -> np.ndarray:
    """One bit of each minimum: two lines agree in a bit with probability (1 + similarity) / 2."""
    bits = ((minima ^ (minima >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)
    return (bits << np.arange(BANDS * ROWS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def alike(a: Column, b: Column) -> Column:
    """Can lines of these sketches be similar? At most AWAY bits differ."""
    return F.bit_count(a.bitwiseXOR(b)) <= AWAY


def _distinct_spans(lines: list[str], span: int) -> np.ndarray:
    """Distinct spans of each line, as far as the kind of its signature depends on them: below ONE the number
    of spans, and from MANY on any number of at least MANY. The first HEAD spans mostly tell; where they
    are too few of a longer line, as in periodic lines, all its spans are counted."""
    sizes = np.maximum(np.fromiter(map(len, lines), np.int64, len(lines)) - span + 1, 1)
    at = np.flatnonzero(sizes >= ONE)
    if not len(at):
        return sizes
    counts = np.minimum(sizes[at], HEAD)
    h, first = span_hashes([lines[i][: HEAD + span - 1] for i in at], span)
    heads = np.sort(h[first[:, None] + np.minimum(np.arange(HEAD), counts[:, None] - 1)], axis=1)
    found = 1 + np.count_nonzero(heads[:, 1:] != heads[:, :-1], axis=1)
    for i in np.flatnonzero((found < MANY) & (sizes[at] > HEAD)):
        found[i] = len(distinct(span_hashes([lines[at[i]]], span)[0]))
    sizes[at] = found
    return sizes


def band_keys(lines: list[str], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys of lines (not blank): the number of each line's keys, and all keys in line order
    with the sketches of the signatures that they come from."""
    width = BANDS * ROWS
    sizes = _distinct_spans(lines, span)
    few, long = np.flatnonzero(sizes < MANY), np.flatnonzero(sizes >= ONE)
    rows, keys, sketches = [], [], []
    if len(few):
        h, starts = span_hashes([lines[i] for i in few], span)
        x = (h >> np.uint64(32)).astype(np.uint32)
        minima, product = np.empty((width, len(few)), np.uint32), np.empty_like(x)
        for i, f in enumerate(_factors):
            np.minimum.reduceat(np.multiply(x, f, out=product), starts, out=minima[i])
        minima = minima.T.astype(np.uint64, order="C")
        rows.append(np.repeat(few, BANDS))
        keys.append(_bands(minima, 0).ravel())
        sketches.append(np.repeat(_sketch(minima), BANDS))
    if len(long):
        x, starts = span_hashes([lines[i] for i in long], max(span, SPAN))
        cells = np.repeat(np.arange(len(long)) * width, np.diff(np.append(starts, len(x)))) + ((x >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
        empty = np.uint64(2**64 - 1)
        minima = np.full(len(long) * width, empty, np.uint64)
        np.minimum.at(minima, cells, x & np.uint64(0xFFFFFFFF))
        minima = minima.reshape(len(long), width)
        shift = 1
        while (minima == empty).any():  # an empty bin takes from a later one
            minima = np.where(minima == empty, np.roll(minima, -shift, axis=1), minima)
            shift *= 2
        rows.append(np.repeat(long, BANDS))
        keys.append(_bands(minima[:, : BANDS * LONG_ROWS], 1).ravel())
        sketches.append(np.repeat(_sketch(minima), BANDS))
    rows, keys, sketches = (np.concatenate(x) for x in (rows, keys, sketches))
    order = np.argsort(rows, kind="stable")
    return np.bincount(rows, minlength=len(lines)), keys[order].view(np.int64), sketches[order].view(np.int64)


def line_items(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, id, line) of each line that takes part; the normalised line where a task
    meets it first."""

    def run(batches):
        seen: set[int] = set()
        doc, no, ids, lines = [], [], [], []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(ids, pa.int64()), pa.array(lines, pa.string())], ["doc_id", "line_no", "id", "line"])
            for x in (doc, no, ids, lines):
                x.clear()
            return out

        for b in batches:
            size = 0
            for d, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                for n, line in enumerate((text.as_py() or "").split("\n")):
                    norm = normalised(line)
                    if norm:
                        i = line_id(norm)
                        doc.append(d)
                        no.append(n)
                        ids.append(i)
                        fresh = i not in seen
                        lines.append(norm if fresh else None)
                        if fresh:
                            if len(seen) > REMEMBER:
                                seen.clear()
                            seen.add(i)
                            size += len(norm)
                    if size >= SLICE or len(ids) >= 50_000:
                        yield flush()
                        size = 0
            yield flush()

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return save(rows.mapInArrow(run, "doc_id long, line_no int, id long, line string"), dictionary=False)


def line_keys(lines: DataFrame, span: int = SPAN) -> DataFrame:
    """(id, key, sketch) of the lines under each band key that lines of different ids have; other keys link nothing.

    Most keys belong to one line, so keys don't travel as rows: a task packs the (key, id, sketch) of many lines by buckets of
    keys, and a row of the shuffle holds all of a bucket. The task that meets a bucket keeps one line of each key and emits the
    others as they come: it holds the distinct keys of a bucket, however many lines share one. Buckets grow in number with the
    shuffle partitions. Signatures are never stored."""
    spark = lines.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * partitions

    def pack(batches):
        held, count = [], 0
        for b in batches:
            ids, texts, at = b["id"].to_numpy(), b["line"].to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= HASHED):
                    size += len(texts[end])
                    end += 1
                n, keys, sketches = band_keys(texts[at:end], span)
                held.append(np.stack([keys, np.repeat(ids[at:end], n), sketches], axis=1))
                count += len(keys)
                at = end
                if count >= PACKED:
                    yield _packed(np.concatenate(held), buckets)
                    held, count = [], 0
        if held:
            yield _packed(np.concatenate(held), buckets)

    def share(batches):
        bucket, known, fresh, count = None, _NONE, [], 0
        for b in batches:
            for at, rows in zip(b["bucket"].to_pylist(), b["rows"], strict=True):
                if at != bucket or count >= max(PACKED, len(known[0])):
                    known, out = _shared(known, fresh)
                    yield from out
                    fresh, count = [], 0
                    if at != bucket:
                        bucket, known = at, _NONE
                fresh.append(np.frombuffer(rows.as_buffer(), np.int64).reshape(-1, 3))
                count += len(fresh[-1])
        yield from _shared(known, fresh)[1]

    packed = lines.where("line is not null").select("id", "line").mapInArrow(pack, "bucket int, rows binary")
    placed = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(share, "id long, key long, sketch long")


#: One row (key, id, sketch) of each key known so far, and whether it was emitted.
_NONE = (np.empty((0, 3), np.int64), np.empty(0, bool))


def _packed(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row a bucket with the (key, id, sketch) of its keys."""
    of = ((rows[:, 0].view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    of, rows = of[order], rows[order]
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return pa.RecordBatch.from_arrays([pa.array(of[starts]), pa.array([x.tobytes() for x in np.split(rows, starts[1:])], pa.binary())], ["bucket", "rows"])


def _shared(known: tuple[np.ndarray, np.ndarray], fresh: list[np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], list[pa.RecordBatch]]:
    """The keys known after the fresh rows, and the rows of keys that have several ids and were not emitted before."""
    if not fresh:
        return known, []
    rows, sent = np.concatenate([known[0], *fresh]), np.zeros(len(known[0]) + sum(map(len, fresh)), bool)
    sent[: len(known[0])] = known[1]
    order = np.argsort(rows[:, 0], kind="stable")  # a known row comes first of its key
    rows, sent = rows[order], sent[order]
    is_first = np.append(True, rows[1:, 0] != rows[:-1, 0])
    starts = np.flatnonzero(is_first)
    group = np.cumsum(is_first) - 1
    other = rows[:, 1] != rows[starts, 1][group]
    several = np.logical_or.reduceat(other, starts) | sent[starts]
    out = rows[(is_first & ~sent & several[group]) | other]
    emitted = [pa.RecordBatch.from_arrays([pa.array(out[:, c]) for c in (1, 0, 2)], ["id", "key", "sketch"])] if len(out) else []
    return (rows[starts], several), emitted


def line_owners(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, line_no, id, owner) of the lines that do not stay, with the document whose line stays for them."""
    lines = line_items(docs)

    def texts_of(need: DataFrame) -> DataFrame:
        slot = F.col("id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        return sifted(lines.where("line is not null").select("id", F.col("line").alias("text")), need, slot).dropDuplicates(["id"])

    linked = link_components(line_keys(lines, span), None, texts_of, partial(tokens, span=span), PERCENT, alike)
    first = lines.groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    first = save(first.join(linked, first["id"] == linked["node"], "left").where("n > 1 or component is not null").select("id", "first", F.coalesce("component", "id").alias("component")))
    keeper = first.groupBy("component").agg(F.min("first").alias("keep"))
    keeper = first.join(keeper, "component").select("id", "keep")
    gone = lines.select("id", "doc_id", "line_no").join(keeper, "id").where((F.col("keep.doc_id") != F.col("doc_id")) | (F.col("keep.line_no") != F.col("line_no")))
    return gone.select("doc_id", "line_no", "id", F.col("keep.doc_id").alias("owner"))


def removed_lines(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, removed): the line numbers, from 0, that do not stay, of documents with any."""
    return line_owners(docs, span).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def dedup_documents(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents without the lines that do not stay; columns as they came."""
    gone = save(line_owners(docs, span))
    mine, lines, free = (free_name(docs.columns, c) for c in ("own_id", "removed", "owns_none"))
    owners = gone.where("owner <> doc_id").select(F.col("owner").alias("doc_id"), F.lit(False).alias(free)).distinct()
    gone = gone.groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "id", "owner")).alias(lines)).join(owners, "doc_id", "left")
    gone = gone.select(F.col("doc_id").alias(mine), lines, F.coalesce(free, F.lit(True)).alias(free))
    both = docs.join(gone, docs["doc_id"] == gone[mine], "left")
    names, at, lost = docs.columns, docs.columns.index("text"), free_name(docs.columns, "lost")

    def run(batches):
        for b in batches:
            texts, drops = [], []
            for text, doc, removed, owns_none in zip(b["text"], b[mine].to_pylist(), b[lines].to_pylist(), b[free].to_pylist(), strict=True):
                text, drop = text.as_py(), False
                if removed and text is not None:
                    out, stay, total, held = {(x["line_no"], x["id"]): x["owner"] for x in removed}, [], 0, Counter()
                    for n, line in enumerate(text.split("\n")):
                        norm = normalised(line)
                        total += len(norm)
                        owner = out.get((n, line_id(norm))) if norm else None
                        if owner is None:
                            stay.append(line)
                        else:
                            held[owner] += len(norm)
                    held.pop(doc, None)
                    near = owns_none and held and 100 * max(held.values()) >= PERCENT * total
                    drop = near or total > 0 and not any(map(str.strip, stay))
                    text = "\n".join(stay)
                texts.append(text)
                drops.append(bool(drop))
            columns = [b[c] for c in names]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(drops, pa.bool_())], [*names, lost])

    types = dict(docs.dtypes)
    kept = both.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + f", `{lost}` boolean").where(~F.col(lost))
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(types["n_chars"]))
    return kept.select(*names)


def op10_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (line numbers, from 0)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    gone = removed_lines(docs, SHORT_SPAN)
    counted = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return counted.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
