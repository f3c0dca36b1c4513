"""Document fingerprints from prefix polynomial hashes.

A text's code points c[0..n) give prefix arrays H[i] = sum of (c[j] + 1) * x**j over j < i,
modulo two primes. Any span is then compared in constant time: spans [i, i+k) and [j, j+k)
are equal when (H[i+k] - H[i]) * x**(N-i) = (H'[j+k] - H'[j]) * x**(N-j), and the longest
common extension of two positions is found by binary search over k.

The fingerprint is the pair of whole-text hashes and the ``SKETCH`` smallest distinct hashes
of all spans of ``SPAN`` code points (of the whole text where it is shorter), as lowercase hex.
The likeness of two fingerprints is 1 when the whole-text hashes are equal and otherwise the
share of common span hashes among the smallest of their union: an unbiased estimate of the
Jaccard similarity of the span sets.

Two texts at hand are compared by spans: ``shared_prefix`` is the longest common extension of
the text and its edited text from their beginnings, ``shared_next`` the longest passage common
with the next document that holds a span of both sketches; such spans count only if both hashes
agree, and are extended both ways by binary search.

The next document of each document is needed without moving a text twice: documents are
dealt by a block of neighbouring ids (one shuffle of the texts), sorted, and read as a
stream. Only the first and last text of a block go through a second, small exchange; which
block comes next is found level by level on prefixes of the id, so that no window ever holds
more than 65,536 groups.

Defined results: a null text counts as empty; the fingerprint of an empty text has no span
hashes, two empty texts have likeness 1, an empty and another 0. Rows with a null id come
last. Rows with equal ids follow each other in order of their text. One row alone is its own next document. Empty table: empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SPAN, SKETCH = 16, 64
P1, X1 = np.uint64(2147483647), 1_000_003
P2, X2 = np.uint64(2147483629), 91_138_233
#: Code points hashed at a time; longer texts go chunk by chunk with SPAN - 1 overlap.
CHUNK = 1 << 20
#: Ids of a block: 2**BLOCK_BITS neighbouring ids are dealt together.
BLOCK_BITS = 8


def codes(text: str) -> np.ndarray:
    """Code points of a text, four bytes each; they are widened chunk by chunk."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Powers:
    """x**j mod p for j up to the longest text met, grown by doubling."""

    def __init__(self, x: int, p: np.uint64):
        self.p, self.up = p, np.array([1, x], np.uint64)
        self.inverse = pow(x, int(p) - 2, int(p))
        self.down = np.array([1, self.inverse], np.uint64)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            for name in ("up", "down"):
                have = getattr(self, name)
                top = have[k - 1] * have[1] % self.p
                setattr(self, name, np.concatenate([have, have * top % self.p]))


POWERS = (Powers(X1, P1), Powers(X2, P2))


class PrefixHash:
    """Prefix arrays of one text: span hashes, span equality and common extensions."""

    def __init__(self, text: np.ndarray, moduli: int = 2):
        self.n, self.prefix = len(text), []
        text = text.astype(np.uint64) + np.uint64(1)
        for w in POWERS[:moduli]:
            w.grow(self.n + 1)
            # terms are below 2**31, so sums of up to 2**32 of them fit; one reduction at the end
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text % w.p * w.up[: self.n] % w.p)])
            self.prefix.append(sums % w.p)

    def spans(self, starts: np.ndarray, length: int, modulus: int = 0) -> np.ndarray:
        w, h = POWERS[modulus], self.prefix[modulus]
        return (h[starts + length] + w.p - h[starts]) % w.p * w.down[starts] % w.p

    def span(self, start: int, length: int) -> tuple[int, ...]:
        return tuple(int(self.spans(np.array([start]), length, m)[0]) for m in range(len(self.prefix)))

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return self.span(i, length) == other.span(j, length)

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common prefix of self[i:] and other[j:]."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low


def whole_hash(text: np.ndarray) -> str:
    totals = []
    for w in POWERS:
        w.grow(min(len(text), CHUNK) + 1)
        total, shift = 0, 1
        for s in range(0, len(text), CHUNK):
            part = text[s : s + CHUNK].astype(np.uint64) + np.uint64(1)
            total = (total + int((part % w.p * w.up[: len(part)] % w.p).sum()) * shift) % int(w.p)
            shift = shift * pow(int(w.up[1]), CHUNK, int(w.p)) % int(w.p)
        totals.append(total)
    return f"{totals[0]:08x}{totals[1]:08x}"


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads span hashes, so that the smallest are a fair sample."""
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)


def sketch(text: np.ndarray) -> np.ndarray:
    """The SKETCH smallest distinct mixed span hashes, ascending."""
    if not len(text):
        return np.empty(0, np.uint64)
    best = np.empty(0, np.uint64)
    for s in range(0, max(1, len(text) - SPAN + 1), CHUNK):
        part = text[s : s + CHUNK + SPAN - 1]
        length = min(SPAN, len(part))
        h = mix(PrefixHash(part, 1).spans(np.arange(len(part) - length + 1), length))
        bound = np.uint64(min(2**32 - 1, (4 * SKETCH << 32) // len(h)))
        while True:
            few = np.unique(h[h <= bound])
            if len(few) >= SKETCH or bound == np.uint64(2**32 - 1):
                break
            bound = np.uint64(min(2**32 - 1, int(bound) * 4))
        best = np.unique(np.concatenate([best, few]))[:SKETCH]
    return best


def extension(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix of two texts: by prefix hashes, in growing chunks."""
    at, size = 0, 4096
    while True:
        n = PrefixHash(a[at : at + size]).common_extension(0, PrefixHash(b[at : at + size]), 0)
        at += n
        if n < size:
            return at
        size = min(2 * size, CHUNK)


def _places(text: np.ndarray, wanted: np.ndarray) -> dict[int, int]:
    """The first place of each wanted span hash."""
    found: dict[int, int] = {}
    for s in range(0, max(1, len(text) - SPAN + 1), CHUNK):
        part = text[s : s + CHUNK + SPAN - 1]
        length = min(SPAN, len(part))
        h = mix(PrefixHash(part, 1).spans(np.arange(len(part) - length + 1), length))
        at = np.flatnonzero(np.isin(h, wanted))
        for v, i in zip(h[at].tolist(), at.tolist(), strict=True):
            found.setdefault(v, s + i)
    return found


def shared_passage(a: np.ndarray, b: np.ndarray, own: str, other: str) -> int:
    """Length of the longest common passage that holds a span of both fingerprints' sketches."""
    if own == other:
        return len(a)
    x, y = ({int(s[i : i + 8], 16) for i in range(16, len(s), 8)} for s in (own, other))
    if not x & y:
        return 0
    wanted = np.array(sorted(x & y), np.uint64)
    here, there = _places(a, wanted), _places(b, wanted)
    best, known = 0, []  # first place, end and shift of the passages found
    for v, i in sorted(here.items(), key=lambda p: p[1]):
        j, k = there[v], SPAN
        if any(low <= i < high and j - i == shift for low, high, shift in known):
            continue
        if not PrefixHash(a[i : i + k]).equal(0, PrefixHash(b[j : j + k]), 0, min(k, len(a) - i, len(b) - j)):
            continue
        before, after = extension(a[:i][::-1], b[:j][::-1]), extension(a[i:], b[j:])
        known.append((i - before, i + after, j - i))
        best = max(best, before + after)
    return best


def fingerprint(text: np.ndarray) -> str:
    return whole_hash(text) + "".join(f"{h:08x}" for h in sketch(text).tolist())


def likeness(a: str, b: str) -> float:
    """From two fingerprints: 1 for equal texts, else the estimated span Jaccard."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 8] for i in range(16, len(s), 8)} for s in (a, b))
    union = sorted(x | y)[:SKETCH]
    return sum(h in x and h in y for h in union) / len(union) if union else 0.0


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


RESULT = ("n_chars long", "edited_sha256 string", "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double", "shared_prefix long", "shared_next long")


def judge(text: str, following: str, own: str, after: str) -> tuple:
    changed = edited(text, following)
    a, b, c = codes(text), codes(changed), codes(following)
    other = fingerprint(b)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), sha, own, other, likeness(own, other), likeness(own, after), extension(a, b), shared_passage(a, c, own, after)


def _following_block(ends: DataFrame) -> DataFrame:
    """(block, following): for each block the next lower existing one; for the lowest, the
    highest. Null, the block of null ids, is the lowest of all."""
    levels = [ends.select(F.col("block").alias("key")).distinct()]
    for _ in range(4):
        levels.append(levels[-1].select(F.shiftright("key", 16).alias("key")).distinct())
    known = None
    for level in reversed(levels):  # from the few highest prefixes down
        if known is None:
            w = Window.orderBy(F.desc("key"))
            known = level.withColumn("following", F.lead("key").over(w))  # prefixes of 64 bits or more: few rows
            continue
        top = level.groupBy(F.shiftright("key", 16).alias("up")).agg(F.max("key").alias("first"))
        w = Window.partitionBy("up").orderBy(F.desc("key"))
        inside = level.withColumn("up", F.shiftright("key", 16)).withColumn("within", F.lead("key").over(w))
        beyond = known.join(top.select(F.col("up").alias("following"), F.col("first")), "following", "left").select(F.col("key").alias("up"), "first")
        known = inside.join(beyond, "up", "left").select("key", F.coalesce("within", "first").alias("following"))
    return known.select(F.col("key").alias("block"), "following")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next; the next document is the next lower id, after the last the first."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = F.lit(-(2**63)).cast("long")  # stands for a null id: below all others
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), low).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.withColumn("block", F.shiftright("id", BLOCK_BITS)).repartition(partitions, "block")
    dealt = dealt.sortWithinPartitions(F.desc("block"), F.desc("id"), "text")
    id_type = dict(docs.dtypes)[id_col]

    def inner(batches):
        """Results of all rows but the last of each block."""
        held = None  # block, id, text, fingerprint
        for b in batches:
            out = []
            for i, text, block in zip(*(b[c].to_pylist() for c in ("id", "text", "block")), strict=True):
                own = fingerprint(codes(text))
                if held and held[0] == block:
                    out.append((held[1], *judge(held[2], text, held[3], own)))
                held = (block, i, text, own)
            yield _batch(out)

    def edges(batches):
        """The first and the last row of each block."""
        held = None
        for b in batches:
            blocks, ids, out = b["block"].to_pylist(), b["id"].to_pylist(), []
            for k, block in enumerate(blocks):
                if held and held[0] == block and k + 1 < len(blocks) and blocks[k + 1] == block:
                    continue  # neither first nor last, nor at the end of the batch
                row = (block, ids[k], b["text"][k].as_py())
                if not held or held[0] != block:
                    out += [(*held, False)] if held else []
                    out.append((*row, True))
                held = row
            yield pa.RecordBatch.from_pylist([dict(zip(EDGE.names, r, strict=True)) for r in out], schema=EDGE)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(EDGE.names, (*held, False), strict=True))], schema=EDGE)

    def across(batches):
        """Results of the last rows of the blocks."""
        for b in batches:
            out = []
            for i, text, following in zip(*(b[c].to_pylist() for c in ("id", "text", "following_text")), strict=True):
                out.append((i, *judge(text, following, fingerprint(codes(text)), fingerprint(codes(following)))))
            yield _batch(out)

    schema = ", ".join(("id long", *RESULT))
    ends = dealt.mapInArrow(edges, "block long, id long, text string, is_first boolean")
    firsts = ends.where("is_first").select(F.col("block").alias("following"), F.col("text").alias("following_text"))
    top = rows.agg(F.max(F.shiftright("id", BLOCK_BITS))).first()[0]  # where the ring closes
    ring = _following_block(rows.select(F.shiftright("id", BLOCK_BITS).alias("block")).distinct())
    ring = ring.select("block", F.coalesce("following", F.lit(top).cast("long")).alias("following"))
    last = ends.where("not is_first").join(ring, "block").join(firsts, "following").select("id", "text", "following_text")
    result = dealt.mapInArrow(inner, schema).unionByName(last.mapInArrow(across, schema))
    return result.select(F.when(F.col("id") != low, F.col("id")).cast(id_type).alias(id_col), *(r.split()[0] for r in RESULT))


EDGE = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("text", pa.string()), ("is_first", pa.bool_())])
TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [("id", pa.int64()), *((r.split()[0], TYPES[r.split()[1]]) for r in RESULT)]
    columns = zip(*rows, strict=True) if rows else ([] for _ in fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
