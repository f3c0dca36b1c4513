"""Whitening of embeddings by block subspace iteration, without forming the covariance.

A vector becomes whole numbers x = floor(64 * c) + 1000000. The fit list has each distinct x once;
its size n and the sums S are exact, so n * x - S is an exact centred row. The leading
eigenvectors of the covariance V come from passes over the fit list: a pass multiplies
Z' (Z Q) for a block Q of BLOCK orthonormal columns, Z being the centred rows, batch by batch
inside the tasks; tasks send sums of size (components x block), which are added up by component.
The driver orthonormalises the products against what it has (QR), solves the small
problem on all directions so far (Rayleigh-Ritz) and takes the residuals V q - e q of the k
leading pairs. The iteration ends when each is below TOLERANCE times the largest eigenvalue; then
each pair is an eigenpair to double precision. Otherwise the new directions of
largest residual are the next block. Keeping earlier directions makes close eigenvalues, as of
embeddings, converge in a few passes where repeated multiplication alone takes thousands; beyond
BASIS directions the leading 2 * BLOCK start anew. Vectors of at most BLOCK components need one pass.

The driver holds BASIS columns of the vectors' width and nothing that grows with the rows. What
the tasks are sent is one block, or the k components.

Defined results: rows whose vector is null, or holds a null or a component that is not finite, take
no part; shorter vectors (empty ones too) count as padded with c = 0; equal vectors count once in
the fit list and every row gets its result, repeated and null ids too; components beyond 2**53 / 64
are cut to that; a deviation beyond a long is cut to the largest. Components of which the variance is
zero (up to rounding: below NOTHING of the trace) have no whitened value and are left out, so
fewer than k come back from few or equal rows, and none from a single distinct vector. Of
eigenvalues that tie any orthonormal basis is right. Empty table, empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, slices, table
from .vectors import EXACT, LONGEST, complete, floored

SCALE, SHIFT, TOP = 64, 1_000_000, 16
#: Columns multiplied in a pass, directions kept at most, residual of a finished pair, share of the
#: trace that counts as no variance, passes before giving up, numbers of a batch.
BLOCK, BASIS, TOLERANCE, NOTHING, PASSES, NUMBERS = 32, 512, 1e-12, 1e-13, 500, 1 << 19


def whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and whole-number vector of the rows that take part."""
    v = F.col(vector_col)
    x = F.transform(floored(v, SCALE), lambda c: F.greatest(F.least(c, F.lit(EXACT)), F.lit(-EXACT)).cast("long") + SHIFT)
    return vectors.where(complete(v)).select(F.col(id_col).alias("vec_id"), x.alias("x"))


@dataclass
class Centre:
    """Exact size and sums of the fit list."""

    n: int
    sums: list[int]
    largest: int

    @property
    def width(self) -> int:
        return len(self.sums)

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - S; in whole numbers of any size where a long could be too short."""
        bound = self.n * self.largest + max(map(abs, self.sums), default=0)
        kind = np.int64 if self.width * bound * bound <= LONGEST or bound <= LONGEST // 2 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.exact(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        d = self.exact(x)
        if d.dtype != object and len(d) and self.width * int(np.abs(d).max(initial=0)) ** 2 > LONGEST:
            d = d.astype(object)
        return [min(int(s), LONGEST) for s in (d * d).sum(1)]


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a column of long lists; shorter ones are filled up with SHIFT."""
    n, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.full((len(n), width), SHIFT, np.int64)
    out[np.arange(width) < n[:, None]] = flat
    return out


def centre(fit: DataFrame, width: int) -> Centre:
    """Sums by component, in decimals, which hold them whatever the rows; components of short vectors count as SHIFT."""
    x = F.posexplode("x").alias("i", "c")
    by = fit.select(x).groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"), F.max(F.abs("c")).alias("m")).collect()  # one row a component
    n = fit.count()
    sums = [n * SHIFT] * width
    for r in by:
        sums[r["i"]] = int(r["s"]) + (n - r["n"]) * SHIFT
    return Centre(n, sums, max([SHIFT, *(r["m"] for r in by)]))


def summed(fit: DataFrame, at: Centre, part: Callable[[np.ndarray], np.ndarray], rows: int, columns: int) -> np.ndarray:
    """The sum of part(Z) over batches of centred rows, a matrix of the given shape: a task sends one
    row for each of its rows, and these are added up in the shuffle."""
    step = max(1, NUMBERS // max(1, at.width))

    def run(batches):
        total = np.zeros((rows, columns))
        for b in slices(batches, step):
            total += part(at.centred(integers(b["x"], at.width)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * columns), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows), pa.int32()), lists], ["i", "y"])

    y = fit.select("x").mapInArrow(run, "i int, y array<double>")
    y = y.groupBy("i").agg(F.array(*[F.sum(F.col("y")[j]) for j in range(columns)]).alias("y")).collect()  # as many rows as asked
    out = np.zeros((rows, columns))
    for r in y:
        out[r["i"]] = r["y"]
    return out


def orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the columns of ``basis``, largest first."""
    size = np.linalg.norm(block, axis=0).max(initial=0.0)
    if not size:
        return block[:, :0]
    block = block / size
    for _ in range(2):  # once more against rounding
        block = block - basis @ (basis.T @ block)
    left, s, _ = np.linalg.svd(block, full_matrices=False)
    left = left[:, s > 1e-10 * max(s.max(initial=0.0), 1e-6)]
    left = left - basis @ (basis.T @ left)
    return np.linalg.qr(left)[0]


@dataclass
class Whitening:
    """Components in columns, eigenvalues, trace of the covariance; passes made and last residuals."""

    at: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    residuals: np.ndarray

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fitted(fit: DataFrame, width: int, k: int = TOP, block: int = BLOCK, basis: int = BASIS, seed: int = 0) -> Whitening:
    """The k leading eigenpairs of the covariance of the saved, distinct rows ``fit``."""
    at = centre(fit, width)
    block, basis = min(width, max(block, k)), min(width, max(basis, 4 * max(block, k)))
    trace = float(summed(fit, at, lambda z: np.array([[(z * z).sum()]]), 1, 1)[0, 0]) / at.n
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, block)))[0]
    have, products = np.zeros((width, 0)), np.zeros((width, 0))
    for passes in range(1, PASSES + 1):
        v = summed(fit, at, lambda z, q=q: z.T @ (z @ q), width, q.shape[1]) / at.n
        have, products = np.hstack([have, q]), np.hstack([products, v])
        small = have.T @ products
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1]
        values, ritz, applied = values[::-1], have @ turn, products @ turn
        rest = applied - ritz * values
        residuals = np.linalg.norm(rest[:, :k], axis=0)
        if (residuals <= TOLERANCE * max(values[0], 0.0)).all():
            good = np.flatnonzero(values[:k] > NOTHING * trace)
            return Whitening(at, ritz[:, good], values[good], trace, passes, residuals)
        if have.shape[1] + block > basis:
            have, products = ritz[:, : 2 * block], applied[:, : 2 * block]
        q = orthonormal(rest[:, :block], have)
        if not q.shape[1]:  # nothing new in the residuals: other directions
            q = orthonormal(np.random.default_rng(seed + passes).standard_normal((width, block)), have)
        if not q.shape[1]:
            raise ArithmeticError(f"all {width} directions used, residuals {residuals.max():.3g} of {values[0]:.3g}")
    raise ArithmeticError(f"residuals {residuals.max():.3g} of {values[0]:.3g} after {PASSES} passes")


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, from a pass of its own."""
    k, scaled = len(w.values), w.scaled
    if not k:
        return 0.0
    got = summed(fit, w.at, lambda z: np.vstack([(y := z @ scaled).T @ y, y.sum(0)]), k + 1, k) / w.at.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row for each row
    that takes part and component."""
    rows = whole(vectors, id_col, vector_col)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    schema = f"vec_id {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    short = F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x"))  # else a short vector and its padded copy are two
    fit = save(rows.select(F.concat("x", short).alias("x")).distinct())
    w = fitted(fit, width, k)
    at, scaled, error, share = w.at, w.scaled, identity_error(fit, w), w.values / w.trace if w.trace else w.values
    found = len(w.values)
    step = max(1, NUMBERS // max(width, found))

    def run(batches):
        for b in slices(batches, step):
            x = integers(b["x"], width)
            y, each = at.centred(x) @ scaled, np.repeat(np.arange(len(x)), found)
            columns = [
                b["vec_id"].take(pa.array(each)), pa.array(np.tile(np.arange(1, found + 1), len(x)), pa.int32()), pa.array(np.full(len(each), at.n), pa.int64()),
                pa.array(at.deviations(x), pa.int64()).take(pa.array(each)), pa.array(y.ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
