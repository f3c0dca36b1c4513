"""Similarity links between items of any count, without emitting the pairs of a group.

Input are the blocking keys of items, and where they differ the items' set sizes n and needs,
such that two items that link have at least the smaller of their needs of keys in common. The links are found in two rounds:

1. Grouping. Under each key an item is tied to the first item and to the one before it (two
   ties, however many items share the key). Items whose ties (by enough keys) lead to the same first
   item, or that share a frequent key, form a family, dealt into groups of bounded size. The ties are
   verified exactly and give first components, which take in large families of copies.
2. Token-group matrix. The groups are the columns, the union of their items' keys the rows.
   Only keys of several components are left. For two groups the keys that both unions hold
   are counted: an upper bound of the keys that any two of their items share. Pairs of groups
   below the need, without a possible size, or all of one component, stay closed. The others
   are opened in cells: the items of one group against those of its partners, compared by
   counting common tokens inside the task, so no pairs of items are ever emitted.

Every pair of items that shares enough keys is thus compared exactly, or excluded by a bound
that holds, or already in one component. Components of both rounds come from distributed union-find.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, save, slices

#: Items of a group, and partners that one task compares with a group.
GROUP, CELL = 128, 256
#: A key of more items is frequent: its items are grouped by it, alike or not.
CROWD = 64
#: Groups of a key that one part of it holds.
PARTNERS = 512
FILTER_BITS = 23


def _out(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values of a short array."""
    x = np.sort(x)
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def verified(left: DataFrame, right: DataFrame, texts_of: Callable, tokens: Callable, percent: int) -> DataFrame:
    """Links (a, b) between the items (cell, id) of ``left`` and those of ``right``, cell by cell,
    as a spanning forest of each cell's links, so a cell of n items gives fewer than n rows.

    The sets are computed from whole texts. A cell's left side is bounded by the caller; its
    right side is dealt into parts of about CELL items, each with a copy of the left side."""
    left, right = left.distinct(), right.distinct()
    many = right.groupBy("cell").count()
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / CELL))
    dealt = save(right.join(many, "cell").select("cell", part.alias("part"), "id", F.lit(1).alias("side")))
    first = left.join(dealt.select("cell", "part").distinct(), "cell").select("cell", "part", "id", F.lit(0).alias("side"))
    wanted = dealt.unionByName(first)
    rows = wanted.join(texts_of(wanted.select("id").distinct()), "id")

    def run(batches):
        cell, held, index, joined, found = None, [], None, {}, []
        for b in slices(batches):
            sets = tokens(b["text"].to_pylist())
            for at, part, side, i, t in zip(*(b[c].to_pylist() for c in ("cell", "part", "side", "id")), sets, strict=True):
                if (at, part) != cell:
                    found += _stars(joined)
                    cell, held, index, joined = (at, part), [], None, {}
                if side == 0:
                    held.append((i, t))
                elif held:
                    index = index or _index(held)
                    for a in _partners(index, t, percent):
                        x, y = sorted((_root(joined, a), _root(joined, i)))
                        joined[y] = x
            if len(found) > 20_000:
                yield _out(found, ["a", "b"])
                found = []
        yield _out(found + _stars(joined), ["a", "b"])

    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(partitions, "cell", "part").sortWithinPartitions("cell", "part", "side", "id")
    return save(placed.select("cell", "part", "side", "id", "text").mapInArrow(run, "a long, b long"))


def _root(joined: dict[int, int], x: int) -> int:
    """Union-find inside a cell, with path halving; the smallest id is the root."""
    while (up := joined.setdefault(x, x)) != x:
        joined[x] = x = joined[up]
    return x


def _stars(joined: dict[int, int]) -> list[tuple[int, int]]:
    """A cell's links as a spanning forest: one row for each item but the roots."""
    return [(r, x) for x in list(joined) if (r := _root(joined, x)) != x]


def _index(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Tokens of all items of a cell's left side in order, their owners, ids and sizes."""
    sizes = np.array([len(t) for _, t in held])
    if len(held) == 1:
        return held[0][1], sizes, np.array([held[0][0]]), sizes
    all_tokens = np.concatenate([t for _, t in held])
    order = np.argsort(all_tokens, kind="stable")
    return all_tokens[order], np.repeat(np.arange(len(held)), sizes)[order], np.array([i for i, _ in held]), sizes


def _partners(index: tuple[np.ndarray, ...], t: np.ndarray, percent: int) -> list[int]:
    """Ids of the left side whose set links with t: common tokens counted over the whole side."""
    all_tokens, owners, ids, sizes = index
    if len(ids) == 1:
        at = np.minimum(np.searchsorted(all_tokens, t), len(all_tokens) - 1)
        shared = int(np.count_nonzero(all_tokens[at] == t)) if len(all_tokens) else 0
        return ids.tolist() if shared and 100 * shared >= percent * (len(all_tokens) + len(t) - shared) else []
    low, high = (np.searchsorted(all_tokens, t, side) for side in ("left", "right"))
    n = high - low
    hits = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    shared = np.bincount(owners[hits], minlength=len(ids))
    return ids[(shared > 0) & (100 * shared >= percent * (sizes + len(t) - shared))].tolist()


def sifted(rows: DataFrame, need: DataFrame, slot) -> DataFrame:
    """The rows whose id is in ``need``. Most others are dropped before the shuffle by a bit filter
    of fixed size: at most 2**(FILTER_BITS - 6) words are broadcast, however many ids there are."""
    at = need.select(slot.alias("s")).select(F.shiftright("s", 6).alias("__word"), F.col("s").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = at.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("__bits"))
    marked = rows.withColumn("__slot", slot).withColumn("__word", F.shiftright("__slot", 6))
    near = marked.join(F.broadcast(words), "__word").where(F.expr("(shiftright(__bits, cast(__slot & 63 as int)) & 1) = 1"))
    # an inner join: a semi-join would be pushed below the filter and shuffle all texts
    return near.select(*rows.columns).join(need.distinct(), "id")


def link_components(keys: DataFrame, sizes: DataFrame | None, texts_of: Callable, tokens: Callable, percent: int, alike: Callable | None = None) -> DataFrame:
    """(node, component) of the items that link to another item.

    keys: id long, key long, and sketch long where ``alike`` says of two sketches whether their items can link; sizes: id long, n long, need int, or None where one common key is
    enough and any sizes can link; texts_of(ids) gives (id, text); tokens(texts) gives the sorted
    distinct hashed tokens of each whole text."""
    w, before = Window.partitionBy("key"), Window.partitionBy("key").orderBy("id")
    # only ids and keys (and sketches) are shuffled: most keys have one item and end here
    sketch = ["sketch"] if alike else []
    item = F.struct("id", *sketch)
    buckets = keys.withColumn("low", F.min(item).over(w)).withColumn("high", F.max("id").over(w)).withColumn("size", F.count("*").over(w))
    buckets = save(buckets.where("low.id <> high").distinct().withColumn("prev", F.lag(item).over(before)).drop("high"))

    tied = buckets.select("id", *sketch, F.explode(F.array_distinct(F.array("low", "prev"))).alias("other")).where("other.id <> id")
    if alike:
        tied = tied.where(alike(F.col("sketch"), F.col("other.sketch")))
    tied = tied.groupBy(F.col("other.id").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("shared"))
    if sizes is not None:
        for side in ("a", "b"):
            tied = tied.join(sizes.select(F.col("id").alias(side), F.col("need").alias(f"need_{side}")), side)
        tied = tied.where(F.col("shared") >= F.least("need_a", "need_b"))
    tied = save(tied.select("a", "b"))
    links = verified(tied.select(F.col("a").alias("cell"), F.col("a").alias("id")), tied.select(F.col("a").alias("cell"), F.col("b").alias("id")), texts_of, tokens, percent)
    first = components(links)
    # the first item that an item is tied to; under a frequent key, the first item of the key
    near = tied.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("near"))
    crowd = buckets.where(F.col("size") > CROWD).groupBy("id").agg(F.min("low.id").alias("crowd"))
    family = crowd.join(near, "id", "full_outer").select("id", F.coalesce("crowd", "near").alias("family"))

    named = buckets.select("key", "id", *sketch).join(first, buckets["id"] == first["node"], "left").select("key", "id", *sketch, F.coalesce("component", "id").alias("comp"))
    named = named.withColumn("low", F.min("comp").over(w)).withColumn("high", F.max("comp").over(w)).where("low <> high").drop("low", "high")
    named = save(named.join(family, "id", "left").withColumn("family", F.coalesce("family", "id")))
    members = named.select("id", "comp", "family").distinct()
    members = members.withColumns({"n": F.lit(0).cast("long"), "need": F.lit(1)}) if sizes is None else members.join(sizes, "id")
    count = members.groupBy("family").count()
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / GROUP))
    members = save(members.join(count, "family").withColumn("g", F.xxhash64("family", part)).select("id", "n", "need", "comp", "g"))
    groups = save(members.groupBy("g").agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("need").alias("need"), F.min("comp").alias("low"), F.max("comp").alias("high")))
    matrix = named.select("key", "id").join(members.select("id", "g"), "id").select("key", "g").distinct().join(groups, "g")
    # a key of many groups is dealt into parts, so that no task meets all its pairs
    parts = F.ceil(F.count("*").over(w) / PARTNERS).cast("int")
    matrix = save(matrix.withColumn("parts", parts))
    partner = matrix.withColumn("part", F.pmod(F.xxhash64("g"), F.col("parts")).cast("int")).drop("parts")
    partner = partner.withColumnsRenamed({c: f"o_{c}" for c in partner.columns if c not in ("key", "part")})
    spread = matrix.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    possible = (F.lit(percent) * F.col("n_min") <= F.lit(100) * F.col("o_n_max")) & (F.lit(percent) * F.col("o_n_min") <= F.lit(100) * F.col("n_max"))
    several = (F.least("low", "o_low") != F.greatest("high", "o_high")) & (F.col("g") < F.col("o_g"))
    overlap = spread.join(partner, ["key", "part"]).where(possible & several)
    overlap = overlap.groupBy("g", "o_g").agg(F.count("*").alias("shared"), F.min(F.least("need", "o_need")).alias("least"))
    opened = overlap.where("shared >= least").select(F.col("g").alias("cell"), F.col("o_g").alias("g"))
    own = groups.where("low <> high").select(F.col("g").alias("cell"), "g")
    if alike:
        held = named.select("id", "sketch").distinct().join(members.select("id", "g").distinct(), "id")
        held = save(held.groupBy("g").agg(F.collect_set("sketch").alias("sketches")))  # of at most GROUP items, about
        opened = opened.join(held, "g").join(held.select(F.col("g").alias("cell"), F.col("sketches").alias("others")), "cell")
        opened = opened.where(F.exists("sketches", lambda x: F.exists("others", lambda y: alike(x, y)))).select("cell", "g")
    opened = save(opened.unionByName(own))
    left = opened.select("cell").distinct().join(members.select(F.col("g").alias("cell"), "id"), "cell")
    right = opened.join(members.select("g", "id"), "g").select("cell", "id")
    more = verified(left, right, texts_of, tokens, percent)
    return components(links.unionByName(more))
