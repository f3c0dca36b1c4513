"""Exact top-k inner-product search as a Voronoi join.

Vectors are turned into integers (floor of 1024 times each component). A bounded sample of
rows gives the pivots (a few rounds of k-means); every row belongs to the cell of its nearest
pivot, and inside a cell to a shell of similar distance from it. Per shell a summary of fixed
size is kept: rows, radius around the pivot, largest norm and the smallest and largest value of
each component. Queries are grouped by their cells, neighbouring cells together, into groups of
bounded size. Each query is first solved in chunks near its own cell, which gives a k-th best
score that is certainly reached. It then visits only the chunks whose upper bound, the least of
q.p + |q| r, |q| times the largest norm, the cone around the pivot, and the sum of
max(q_i lo_i, q_i hi_i), reaches that score; no other chunk can hold a better row. A data row is
shipped once for each query group that visits its chunk, and to no other.

Chunks and groups have a bounded size, so a cell with a third of all rows is many tasks, and so
are many rows of one id. The best of each chunk are merged per query. Where vectors have no
clusters no bound can exclude anything, and every chunk is visited: the work is then that of all
pairs, in blocks. Scores are exact integers; products that could pass 2**53 are computed with
whole numbers of any size.

Defined results: rows whose vector is null, or holds a null or a component that is not
finite, take no part, neither as query nor as candidate; shorter vectors count as padded with
zeros; a query is no candidate of its own, other rows with an equal vector are; ties go to
the smaller id; fewer candidates than k give fewer rows; repeated ids are kept as rows: a candidate row counts
once for each query row of an id, and the k best of all these are the id's result, as in SQL;
scores beyond a long are cut to its limits; rows with a null id take no part; empty table, empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, slices, table

SCALE, TOP, EVERY = 1024, 10, 100
#: Bounds: pivots, shells of a cell, rows of a pivot aimed at, numbers held by a chunk or a group of
#: queries, rows of one, components that the bounds look at (the norm of the rest is added).
PIVOTS, SHELLS, CELL_ROWS, NUMBERS, MOST_ROWS, HEAD = 1024, 4, 2048, 1 << 20, 8192, 4096
#: Candidates near a query that the first round looks at, at least.
NEAR = 256
EXACT = 2.0**53
#: Components near the largest double overflow to infinite bounds, which exclude nothing.
quiet = np.errstate(over="ignore", invalid="ignore")
FOUND = "query_row long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and integer vector (kept as doubles, exact) of the rows that take part."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x):
        y = F.greatest(F.least(x.cast("double") * SCALE, F.lit(1.7e308)), F.lit(-1.7e308))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, whole).alias("v"))


def matrix(column, start: int, width: int) -> np.ndarray:
    """Components start..start+width of vectors of any length, padded with zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        part = v[start : start + width]
        out[i, : len(part)] = part
    return out


def tail_norm(column, head: int) -> np.ndarray:
    return np.array([np.linalg.norm(v[head:]) if len(v) > head else 0.0 for v in column])


def k_means(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """At most k distinct centres of a sample."""
    centres = np.unique(x[:: max(1, len(x) // k)][:k], axis=0)
    for _ in range(rounds):
        at = nearest(x, centres)[0]
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = sums[n > 0] / n[n > 0][:, None]
    return np.unique(centres, axis=0)


@quiet
def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the distance, rounded up."""
    cell, far = np.empty(len(x), np.int32), np.empty(len(x))
    for s in range(0, len(x), 1024):
        part = x[s : s + 1024]
        d = (part**2).sum(1)[:, None] - 2 * part @ centres.T + (centres**2).sum(1)
        cell[s : s + 1024] = at = d.argmin(1)
        far[s : s + 1024] = np.linalg.norm(part - centres[at], axis=1) * (1 + 1e-9)
    return cell, far


@dataclass
class Summary:
    """What is known of the shells: arrays with one entry for each."""

    cell: np.ndarray
    shell: np.ndarray
    n: np.ndarray
    far: np.ndarray
    norm: np.ndarray
    tail: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    centre: np.ndarray
    parts: np.ndarray
    first: np.ndarray

    @quiet
    def bound(self, q: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """For each query and shell a score that no row of the shell exceeds."""
        size = np.linalg.norm(q, axis=1)[:, None]
        dot = q @ self.centre.T
        ball = dot + size * self.far
        box = np.maximum(q, 0) @ self.hi.T + np.minimum(q, 0) @ self.lo.T
        cap = size * self.norm
        # the cone: no row's direction is farther from the pivot's than asin(far / |p|)
        length = np.linalg.norm(self.centre, axis=1)
        wide = np.where(self.far < length, np.arcsin(np.clip(self.far / np.maximum(length, 1e-300), 0, 1)), np.pi)
        angle = np.arccos(np.clip(dot / np.maximum(size * length, 1e-300), -1, 1))
        cone = np.where(angle > wide, cap * np.cos(np.minimum(angle - wide, np.pi)), cap)
        cone = np.where(cone < 0, 0, cone)  # a shorter row of the shell comes nearer to zero
        head = np.minimum(np.minimum(ball, box), np.minimum(cone, cap))
        return head + tail[:, None] * self.tail + 1 + 1e-7 * (cap + size * length)  # rounding


def placed(rows: DataFrame, pivots: np.ndarray, head: int) -> DataFrame:
    """Adds the cell (nearest pivot), the distance to it and a number of the row."""
    step = max(1, NUMBERS // head)

    def run(batches):
        for b in slices(batches, step):
            cell, far = nearest(matrix(b["v"].to_numpy(zero_copy_only=False), 0, head), pivots)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(cell), pa.array(far)], ["vec_id", "v", "cell", "far"])

    found = rows.mapInArrow(run, "vec_id long, v array<double>, cell int, far double")
    return save(found.withColumn("row", F.monotonically_increasing_id()))


def summary(data: DataFrame, pivots: np.ndarray, head: int, chunk_rows: int) -> tuple[DataFrame, Summary]:
    """Adds the shell to each row and the shells' summaries: at most PIVOTS * SHELLS rows of fixed width."""
    share = [i / SHELLS for i in range(1, SHELLS)]
    borders = data.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("far", share, 1000).alias("at")).toPandas()
    split = {int(c): [float(x) for x in at] for c, n, at in zip(borders["cell"], borders["n"], borders["at"], strict=True) if n > chunk_rows}
    at = F.array(*[F.array(*map(F.lit, split.get(c, []))).cast("array<double>") for c in range(len(pivots))])[F.col("cell")]
    data = data.withColumn("shell", F.size(F.filter(at, lambda x: x < F.col("far"))).cast("int"))

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for s in range(0, len(whole), step):
                for (cell, shell), g in whole.iloc[s : s + step].groupby(["cell", "shell"]):
                    x, tail = matrix(g["v"], 0, head), tail_norm(g["v"], head)
                    yield pd.DataFrame({"cell": [cell], "shell": [shell], "n": [len(g)], "far": [g["far"].max()], "norm": [np.linalg.norm(x, axis=1).max()], "tail": [tail.max()], "lo": [x.min(0)], "hi": [x.max(0)]})

    step = max(1, NUMBERS // head)
    key, most = ["cell", "shell"], [F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("far", "norm", "tail"))]
    parts = data.select("cell", "shell", "far", "v").mapInPandas(part, "cell int, shell int, n long, far double, norm double, tail double, lo array<double>, hi array<double>")
    parts = save(parts)
    box = parts.select(*key, F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "b")).groupBy(*key, "i").agg(F.min("b.lo").alias("lo"), F.max("b.hi").alias("hi"))
    box = box.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("b"))  # head entries each
    s = parts.groupBy(*key).agg(*most).join(box, key).toPandas().sort_values(key)
    n = s["n"].to_numpy(np.int64)
    pieces = -(-n // chunk_rows)
    lo, hi = (np.array([[e[i] for e in b] for b in s["b"]]) for i in (1, 2))
    cell = s["cell"].to_numpy()
    return data, Summary(cell, s["shell"].to_numpy(), n, *(s[c].to_numpy() for c in ("far", "norm", "tail")), lo, hi, pivots[cell], pieces, np.cumsum(pieces) - pieces)


def portions(at: np.ndarray, per: np.ndarray, first: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each i the pairs (at[i], first[i] + 0 .. per[i] - 1), in arrays of at most ``most`` of them."""
    ends = np.cumsum(per)
    for s in range(0, int(ends[-1]) if len(ends) else 0, most):
        place = np.arange(s, min(s + most, ends[-1]))
        i = np.searchsorted(ends, place, side="right")
        yield at[i], (first[i] + place - (ends[i] - per[i])).astype(np.int32)


def query_groups(counts: dict[int, int], pivots: np.ndarray, most: int) -> dict[int, tuple[int, int]]:
    """For each cell with queries its first group and the groups it is dealt into: a cell with many queries
    has groups of its own, cells with few share one with those next to them."""
    rest, out, group, held = sorted(counts), {}, 0, 0
    at = rest[0]
    while rest:
        rest.remove(at)
        n = counts[at]
        if held and held + n > most:
            group, held = group + 1, 0
        out[at] = (group, max(1, -(-n // most)))
        held += n
        if held >= most:
            group, held = group + out[at][1], 0
        if rest:
            at = rest[int(((pivots[rest] - pivots[at]) ** 2).sum(1).argmin())]
    return out


@quiet
def _scores(q: list, x: list) -> np.ndarray:
    """Exact inner products of ragged vectors, by blocks of components."""
    width = min(max(map(len, q)), max(map(len, x)))
    most = max(np.linalg.norm(v) for v in q) * max(np.linalg.norm(v) for v in x)
    exact = most < EXACT
    out = np.zeros((len(q), len(x)), float if exact else object)
    for s in range(0, width, HEAD):
        a, b = matrix(q, s, min(HEAD, width - s)), matrix(x, s, min(HEAD, width - s))
        if exact:
            out += a @ b.T
        else:
            a, b = (np.frompyfunc(int, 1, 1)(m) for m in (a, b))
            out += a @ b.T
    return out.astype(np.int64) if exact else np.clip(out, -(2**63), 2**63 - 1).astype(np.int64)


def _solve(k: int):
    """Best k rows of one chunk for each query of one group."""

    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(data):
            data = data.sort_values("vec_id", kind="stable")
            ids, x = data["vec_id"].to_numpy(), list(data["v"])
            step = max(1, NUMBERS * 4 // len(data))
            for s in range(0, len(queries), step):
                some = queries.iloc[s : s + step]
                q_ids, row = some["query_id"].to_numpy(), some["query_row"].to_numpy()
                scores = _scores(list(some["q"]), x)
                own = q_ids[:, None] == ids[None, :]
                for i, line in enumerate(scores):
                    there = np.flatnonzero(~own[i])
                    line = line[there]
                    best = np.flatnonzero(line >= np.partition(line, len(line) - k)[len(line) - k]) if len(line) > k else np.arange(len(line))
                    best = best[np.argsort(~line[best], kind="stable")][:k]  # ~ reverses the order of whole numbers
                    out.append(pd.DataFrame({"query_row": row[i], "query_id": q_ids[i], "vec_id": ids[there[best]], "score": line[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return run


@dataclass
class Plan:
    """The join before it is solved: queries with the chunks they visit, data rows with their chunk."""

    queries: DataFrame
    visits: DataFrame
    dealt: DataFrame
    chunks: int
    found: DataFrame


def plan(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str) -> Plan | None:
    rows = quantised(vectors, id_col, vector_col)
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return None
    head = max(1, min(width, HEAD))
    chunk_rows = max(1, min(MOST_ROWS, NUMBERS // head))
    wanted = int(max(1, min(PIVOTS, NUMBERS // head, max(16, n // CELL_ROWS))))
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(min(16 * wanted, 4 * NUMBERS // head)).select("v").toPandas()
    pivots = k_means(matrix(sample["v"], 0, head), wanted)
    data, cells = summary(placed(rows, pivots, head), pivots, head, chunk_rows)

    slot, numbers = cells.cell * SHELLS + cells.shell, np.ones((2, len(pivots) * SHELLS), np.int64)
    numbers[:, slot] = cells.first, cells.parts
    number, pieces = (F.array(*map(F.lit, v.tolist()))[F.col("cell") * SHELLS + F.col("shell")] for v in numbers)
    dealt = data.select("vec_id", "v", (number + F.pmod(F.xxhash64("row"), pieces)).cast("int").alias("chunk"))

    # equal query rows are solved once, or each would count the candidates of the first round again
    queries = data.where(is_query).groupBy(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "cell").agg(F.count("*").alias("copies"))
    queries = save(queries.withColumn("query_row", F.monotonically_increasing_id()))
    counts = {r["cell"]: r["count"] for r in queries.groupBy("cell").count().collect()}  # PIVOTS rows
    if not counts:
        return None
    groups = query_groups(counts, pivots, chunk_rows)
    group, deal = (F.array(*[F.lit(groups.get(c, (0, 1))[i]) for c in range(len(pivots))])[F.col("cell")] for i in (0, 1))
    asked = queries.select("query_row", "query_id", "q", "cell", (group + F.pmod(F.xxhash64("query_row"), deal)).cast("int").alias("grp"))

    # first round: one chunk of each of the nearest shells, until there are rows enough
    near: list[list[int]] = [[] for _ in pivots]
    for c in counts:
        order = np.argsort(-(cells.centre @ pivots[c]), kind="stable")
        take = int(np.searchsorted(np.cumsum(np.minimum(cells.n, chunk_rows)[order]), max(NEAR, 4 * k))) + 1
        near[c] = [int(cells.first[s]) for s in order[:take]]
    home = F.array(*[F.array(*map(F.lit, xs)).cast("array<int>") for xs in near])[F.col("cell")]
    found = solved(asked.withColumn("chunk", F.explode(home)), dealt, k)
    best = F.element_at(F.sort_array(F.collect_list("score"), asc=False), k)  # k rows of each of the nearest chunks
    reached = found.groupBy("query_row").agg(F.when(F.count("*") >= k, best).alias("reached"))

    def visited(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The chunks of the shells that can hold a row as good as the score reached."""
        for whole in frames:
            for s in range(0, len(whole), step):
                f = whole.iloc[s : s + step]
                bound = cells.bound(matrix(f["q"], 0, head), tail_norm(f["q"], head))
                need = f["reached"].astype("float64").fillna(-np.inf).to_numpy()
                at, shell = np.nonzero(~(bound < need[:, None]))
                per = cells.parts[shell]
                for rows, chunk in portions(at, per, cells.first[shell], most):
                    out = f.iloc[rows].drop(columns="reached")
                    out["chunk"] = chunk
                    yield out[["query_row", "query_id", "q", "grp", "chunk"]]

    # the bounds are matrices of queries by shells, and each visit carries its query
    step, most = max(1, NUMBERS // max(head, len(cells.cell))), max(1, NUMBERS // width)
    wide = asked.drop("cell").join(reached, "query_row", "left")
    visits = wide.mapInPandas(visited, "query_row long, query_id long, q array<double>, grp int, chunk int")
    return Plan(queries, visits, dealt, int(cells.parts.sum()), found)


def solved(visits: DataFrame, dealt: DataFrame, k: int) -> DataFrame:
    """The k best rows of each visited chunk; data goes to the groups that visit it."""
    pairs = visits.select(F.col("grp").alias("to"), F.col("chunk").alias("part")).distinct()
    shipped = dealt.join(pairs, dealt["chunk"] == pairs["part"]).select("vec_id", "v", "to", "part")
    return visits.groupBy("grp", "chunk").cogroup(shipped.groupBy("to", "part")).applyInPandas(_solve(k), FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of every query row."""
    made = plan(vectors, is_query, k, id_col, vector_col)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = solved(made.visits, made.dealt, k)
    copies = made.queries.where("copies > 1").select("query_row", "copies")
    found = found.join(copies, "query_row", "left")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("copies", F.lit(1)), F.lit(k)))))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def visited_share(vectors: DataFrame, is_query: Column, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[float, float]:
    """Share of (query, chunk) pairs that are visited, and copies of a data row that are shipped."""
    made = plan(vectors, is_query, k, id_col, vector_col)
    if made is None:
        return 0.0, 0.0
    pairs = made.visits.select("grp", "chunk").distinct()
    return made.visits.count() / (made.queries.count() * made.chunks), made.dealt.join(pairs, "chunk").count() / made.dealt.count()


def op6_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


OP6_SQL = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
      FROM x q JOIN x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
