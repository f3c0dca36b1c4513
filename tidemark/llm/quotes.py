"""Reply-ordered conversations from quoted text.

The quote level of a line is the number of ``>`` marks before it. Consecutive quoted lines of
one level are a passage, and consecutive quoted lines of any level a block. The words of a passage (lower case, without punctuation, across line breaks) are
hashed in windows of ``WINDOW``, twice, four times ... as many, and lines, sentences and passages of fewer words as they are.
The same is done with what a message wrote itself, so a quote that was wrapped anew, or that
cites part of a line, is found. Each hash is looked up among earlier messages of the same
conversation: all that wrote it are candidates. A candidate votes for a passage with the characters that its hashes
cover there, if they are a fifth of it or more. A message's parent is the candidate with most characters
in its outermost quotes (ties: the later one). If no outer quote is found the next
level decides: a passage at level n is looked up among the passages that earlier messages
quote at level n - 1, as the message replied to does, and among what they wrote
themselves. A part of fewer than ``WINDOW`` words that is no line, sentence or passage of its
source is not looked up. Parents give every message its thread, named by the thread's first
message, and its place in it in reply order; sorting by (conv_id, thread_turn, reply_order) gives
the conversations. The text is left without the blocks of which a passage was found and the lines that introduce them; a
block of which nothing was found stays as it is, be it a quote from elsewhere or a prompt in code.

Only messages of conversations with a quote are hashed, and of their hashes only those that a bit filter of
the quoted ones lets pass are shuffled. The lookup numbers the writers of each (conversation, hash, level) in a window and joins
a quoted hash with all earlier ones, in pages of ``PAGE`` writers: a passage that many wrote and many quote is
many pairs, within its conversation, but they are spread over its pages and no task holds them. The order is that of a walk around the
thread's tree, which enters and leaves every message once: each step points to the next, and
doubling of the pointers counts the steps to the end, so the rounds are the logarithm of a thread's
size, a row has a fixed size however long the chain of replies, and no conversation is gathered in one task.

Defined results: a null text has no lines and stays null; a message without quotes, or whose
quotes are not found, starts a thread (null parent_turn, depth 0, reply_order 0); rows with a null conv_id or
turn start threads of their own; rows that share (conv_id, turn) share one parent, of the
largest vote; empty table, empty result; other columns are ignored; conv_id and turn are whole numbers.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, slices, table

MARKS = re.compile(r"^\s{0,3}((?:>\s?)+)")
#: Lines that introduce a quote, as mail programs write them.
INTRODUCES = re.compile(r"^\s*(on\b.{0,200}\bwrote|le\b.{0,200}\ba écrit|am\b.{0,200}\bschrieb\b.*|el\b.{0,200}\bescribió)\s?:?\s*$", re.I)


#: Words of a window; shorter lines, sentences and passages are hashed whole.
WINDOW = 3
#: Writers of a hash on a page, least part of a passage found (one in so many), bits of the filters' places.
PAGE, PART, BITS = 256, 5, 23
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: A word, or one character of a script without blanks.
TOKEN = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\W\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
ENDS = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")


def words(text: str) -> list[str]:
    norm = " ".join(text.split()).lower()
    return TOKEN.findall(norm) or ([norm] if norm else [])


def units(lines: list[str], quoted: bool) -> tuple[list[tuple[int, int, int]], int]:
    """(hash, first character, end) of the windows, and of shorter lines, sentences and passages; all characters.

    Of windows longer than WINDOW a quote needs only as many as cover it."""
    tokens = [words(line) for line in lines]
    flat = [w for t in tokens for w in t]
    ends = [0]
    for w in flat:
        ends.append(ends[-1] + len(w))
    n = len(flat)
    spans = set()

    def short(parts) -> None:
        at = 0
        for k in parts:
            if 0 < k < WINDOW:
                spans.add((at, at + k))
            at += k

    short(map(len, tokens))
    short([n])
    # a line without words counts as one
    plain = [line.lower() if TOKEN.search(line.lower()) else "x" * len(t) for line, t in zip(lines, tokens, strict=True)]
    short(len(TOKEN.findall(s)) for line in plain for s in ENDS.split(line))
    short(len(TOKEN.findall(s)) for s in ENDS.split("\n".join(plain)))
    code = lambda i, j: xxhash.xxh64_intdigest(" ".join(flat[i:j]).encode("utf-8", "surrogatepass"))
    found = [(code(i, j), ends[i], ends[j]) for i, j in spans if j <= n]
    size, h = WINDOW, np.array([code(i, i + WINDOW) for i in range(n - WINDOW + 1)], np.uint64)
    while len(h):
        places = sorted({*range(0, len(h), size if quoted and size > WINDOW else 1), len(h) - 1})
        found += [(int(h[i]), ends[i], ends[i + size]) for i in places]
        h = (h[: max(0, len(h) - size)] * FACTOR + h[size:]) * FACTOR
        h ^= h >> np.uint64(29)
        size *= 2
    return [(x - (1 << 63), i, j) for x, i, j in found], ends[-1]


def marked(lines: list[str]) -> list[tuple[int, str] | None]:
    """Level and rest of each quoted line, None for others."""
    found = [MARKS.match(line) for line in lines]
    return [(m[1].count(">"), line[m.end() :]) if m else None for m, line in zip(found, lines, strict=True)]


def blocks_of(lines: list[str]) -> list[int | None]:
    """The block of each line: of quoted lines, and of a line that introduces one; None of a message's own."""
    quoted, out, block = marked(lines), [], -1
    for k, q in enumerate(quoted):
        if q and (not k or not quoted[k - 1]):
            block += 1
        ahead = next((x for x in (1, 2) if k + x < len(lines) and quoted[k + x]), None)
        out.append(block if q else block + 1 if ahead and INTRODUCES.match(lines[k]) else None)
    return out


def quoted_units(text: str | None) -> list[tuple[int, ...]]:
    """(level, hash, first character, end, block, passage, size of the passage) of the quoted units."""
    if text is None or ">" not in text:
        return []
    lines = text.split("\n")
    passages: list[tuple[int, int, list[str]]] = []
    before = None
    for q, block in zip(marked(lines), blocks_of(lines), strict=True):
        if q is None:
            before = None
        elif not INTRODUCES.match(q[1]):
            if (q[0], block) != before:
                passages.append((q[0], block, []))
            passages[-1][2].append(q[1])
            before = (q[0], block)
    out, at = [], 0
    for p, (level, block, body) in enumerate(passages):
        found, size = units(body, True)
        out += [(level, h, at + i, at + j, block, p, size) for h, i, j in found]
        at += size
    return out


def without(text: str | None, found: set[int]) -> str | None:
    """The text without the given blocks, and without blank lines at the ends where one was taken."""
    if text is None or not found:
        return text
    lines = text.split("\n")
    left = [line for line, block in zip(lines, blocks_of(lines), strict=True) if block not in found]
    return "\n".join(left).strip("\n") if any(map(str.strip, left)) else ""


FIELDS = ("level", "hash", "at", "end", "block", "passage", "size")
QUOTED = pa.list_(pa.struct([(f, pa.int64() if f in ("hash", "at", "end", "size") else pa.int32()) for f in FIELDS]))


def parsed(messages: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            quoted = [[dict(zip(FIELDS, x, strict=True)) for x in quoted_units(t.as_py())] for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["turn"], b["role"], b["text"], pa.array(quoted, QUOTED)], ["conv_id", "turn", "role", "text", "quoted"])

    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    kinds = ", ".join(f"{f}:{'long' if f in ('hash', 'at', 'end', 'size') else 'int'}" for f in FIELDS)
    rows = rows.mapInArrow(run, f"conv_id long, turn long, role string, text string, quoted array<struct<{kinds}>>")
    return save(rows.withColumn("row", F.xxhash64("text")))


def own_units(rows: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, turn, hash) of what messages wrote themselves, as far as it may have been quoted."""
    slot = F.shiftrightunsigned(F.xxhash64("conv_id"), 64 - BITS)
    words = quoted.select(slot.alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("mask")).toPandas()  # at most 2**(BITS - 6) rows
    mask = np.zeros(1 << (BITS - 6), np.uint64)
    mask[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(mask)

    def run(batches):
        for b in slices(batches):
            conv, turn, hashes = [], [], []
            for c, t, text in zip(b["conv_id"].to_pylist(), b["turn"].to_pylist(), b["text"], strict=True):
                at = xxhash.xxh64_intdigest(c.to_bytes(8, "little", signed=True), 42) >> (64 - BITS)
                text = text.as_py()
                if text and int(shared.value[at >> 6]) >> (at & 63) & 1:
                    lines = text.split("\n")
                    found = {h for h, _, _ in units([x for x, block in zip(lines, blocks_of(lines), strict=True) if block is None], False)[0]}
                    conv += [c] * len(found)
                    turn += [t] * len(found)
                    hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (conv, turn, hashes)], ["conv_id", "turn", "hash"])

    own = rows.select("conv_id", "turn", "text").mapInArrow(run, "conv_id long, turn long, hash long")
    slot = F.shiftrightunsigned(F.xxhash64("conv_id", "hash"), 64 - BITS)
    bits = quoted.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("mask"))
    near = own.withColumn("s", slot).withColumn("word", F.shiftright("s", 6)).join(F.broadcast(bits), "word")
    return near.where(F.expr("(shiftright(mask, cast(s & 63 as int)) & 1) = 1")).select("conv_id", "turn", "hash")


def votes(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, row, block, level, depth, source, chars): characters of passages found in earlier messages."""
    rows = rows.where("conv_id is not null and turn is not null")
    # rows that share (conv_id, turn) have characters of their own
    quoted = rows.select("conv_id", "turn", "row", F.explode("quoted").alias("q")).select("conv_id", "turn", "row", "q.*")
    own = own_units(rows, quoted).withColumn("depth", F.lit(0))
    have = own.unionByName(quoted.select("conv_id", "turn", "hash", F.col("level").alias("depth"))).distinct()
    asked = quoted.withColumn("depth", F.explode(F.array_distinct(F.array(F.col("level") - 1, F.lit(0)))))
    key = ["conv_id", "hash", "depth"]
    before = Window.partitionBy(*key).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    both = save(have.withColumn("wrote", F.col("turn")).unionByName(asked, allowMissingColumns=True).withColumn("earlier", F.count("wrote").over(before)))
    writers = both.where("wrote is not null").select(*key, F.expr(f"earlier div {PAGE}").alias("page"), F.col("wrote").alias("source"))
    asked = both.where("wrote is null and earlier > 0").drop("wrote").withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(earlier - 1) div {PAGE}"))))
    pairs = asked.join(writers, [*key, "page"]).where("source < turn")
    # characters that the units of a source cover, each once
    part = ["conv_id", "turn", "row", "block", "passage", "size", "level", "depth", "source"]
    covered = F.max("end").over(Window.partitionBy(*part).orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1))
    pairs = pairs.withColumn("chars", F.greatest(F.lit(0), F.col("end") - F.greatest("at", F.coalesce(covered, F.lit(0)))))
    return pairs.groupBy(*part).agg(F.sum("chars").alias("chars")).where(PART * F.col("chars") >= F.col("size"))


def parents(found: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) of the messages with a quote that was found."""
    total = found.groupBy("conv_id", "turn", "level", "depth", "source").agg(F.sum("chars").alias("chars"))
    best = F.max(F.struct(-F.col("level"), "depth", "chars", "source"))
    return total.groupBy("conv_id", "turn").agg(best.alias("best")).select("conv_id", "turn", F.col("best.source").alias("parent_turn"))


def reply_order(found: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, reply_order, depth) of the messages in threads of several."""
    child = Window.partitionBy("conv_id", "parent_turn").orderBy("turn")
    nodes = found.select("conv_id", "turn").unionByName(found.select("conv_id", F.col("parent_turn").alias("turn"))).distinct()
    first = found.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    after = found.select("conv_id", "turn", "parent_turn", F.lead("turn").over(child).alias("sibling"))
    tree = nodes.join(first, ["conv_id", "turn"], "left").join(after, ["conv_id", "turn"], "left")
    # entering a message leads to its first reply or out again; leaving it to the next reply or out of the parent
    to = lambda turn, leaves: F.struct(turn.alias("turn"), F.lit(leaves).alias("leaves"))
    enters = F.when(F.col("child").isNotNull(), to(F.col("child"), False)).otherwise(to(F.col("turn"), True))
    leaves = F.when(F.col("sibling").isNotNull(), to(F.col("sibling"), False)).when(F.col("parent_turn").isNotNull(), to(F.col("parent_turn"), True))
    step = tree.select("conv_id", F.explode(F.array(
        F.struct(to(F.col("turn"), False).alias("at"), enters.alias("next"), F.lit(1).cast("long").alias("entered"), F.lit(0).cast("long").alias("left")),
        F.struct(to(F.col("turn"), True).alias("at"), leaves.alias("next"), F.lit(0).cast("long").alias("entered"), F.lit(1).cast("long").alias("left")),
    )).alias("s")).select("conv_id", "s.*", F.col("s.at.turn").alias("last"))
    step = save(step)
    while step.where("next is not null").take(1):
        ahead = step.select("conv_id", F.col("at").alias("next"), F.col("next").alias("then"), F.col("entered").alias("e"), F.col("left").alias("l"), F.col("last").alias("end"))
        both = step.join(ahead, ["conv_id", "next"], "left")
        step = save(both.select("conv_id", "at", F.col("then").alias("next"), (F.col("entered") + F.coalesce("e", F.lit(0))).alias("entered"), (F.col("left") + F.coalesce("l", F.lit(0))).alias("left"), F.coalesce("end", "last").alias("last")))
    place = step.where("not at.leaves").select("conv_id", F.col("at.turn").alias("turn"), F.col("last").alias("thread_turn"), "entered", (F.col("left") - F.col("entered")).cast("int").alias("depth"))
    size = place.where("turn = thread_turn").select("conv_id", "thread_turn", F.col("entered").alias("size"))
    return place.join(size, ["conv_id", "thread_turn"]).select("conv_id", "turn", "thread_turn", (F.col("size") - F.col("entered")).alias("reply_order"), "depth")


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, parent_turn, thread_turn, reply_order, depth, text."""
    rows = parsed(messages)
    passages = save(votes(rows))
    found = save(parents(passages))
    gone = passages.groupBy("conv_id", "turn", "row").agg(F.collect_set("block").alias("blocks"))
    out = rows.drop("quoted").join(gone, ["conv_id", "turn", "row"], "left").drop("row")

    def run(batches):
        for b in slices(batches):
            texts = [without(t.as_py(), set(x or ())) for t, x in zip(b["text"], b["blocks"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["turn"], b["role"], pa.array(texts, pa.string())], ["conv_id", "turn", "role", "text"])

    plain = out.where("blocks is null").drop("blocks").unionByName(out.where("blocks is not null").mapInArrow(run, "conv_id long, turn long, role string, text string"))
    out = plain.join(found, ["conv_id", "turn"], "left").join(reply_order(found), ["conv_id", "turn"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), zero("reply_order"), zero("depth"), "text")


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
