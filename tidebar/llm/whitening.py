"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The vectors are packed once into blocks of whole numbers in a shared table. With X the centred rows, the iteration keeps
orthonormal right vectors v1, v2, ... and left vectors u1, u2, ... with X V = U B, B upper bidiagonal. A step is one pass
over the blocks: a task forms its rows of p = X g and its part of X'p, which Spark sums over the blocks. Left vectors are as
long as the table, so they are never gathered or stored: each is X w for a w of one entry per dimension, by which U'p is
W'(X'p). Both sides are reorthogonalised in full against all earlier vectors, left ones through that product. A step that
finds nothing new starts again from a random direction, and the iteration runs until the space is used up, so repeated
eigenvalues come out as often as they occur. The singular value decomposition of B, a matrix of one row per dimension, gives
components and deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.session import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BLOCK_CELLS = 1 << 19     # cells of a block, 4 MB at most
LARGEST = 2.0**61         # of a scaled entry, so that it and its shifted form fit a long
LOW = (1 << 26) - 1


@dataclass(frozen=True)
class Space:
    """What the whole fit list has in common: rows, whole sums by dimension of the scaled entries without the shift."""

    n: int
    sums: list[int]

    def times_n_centred(self, cells: np.ndarray) -> np.ndarray:
        """n x - S of each entry, whole numbers; of Python's own size where longs are too short."""
        if self.n * max(int(abs(cells).max(initial=0)), 1) + max(map(abs, self.sums), default=0) < 2**62:
            return cells.astype(np.int64) * self.n - np.array(self.sums, np.int64)
        return cells.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, cells: np.ndarray) -> np.ndarray:
        return self.times_n_centred(cells).astype(float) / self.n


def valid(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null, holds no null and no non-finite entry, nor one whose scaled form fits no long."""
    cells = F.col("embedding").cast("array<double>")
    sound = F.forall(cells, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST / SCALE), F.lit(False)))
    return vectors.where(F.col("embedding").isNotNull()).select("vec_id", cells.alias("embedding")).where(sound)


def of_common_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """Vectors of the most frequent length (the longer on ties), and that length; 0 without rows."""
    first = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = first.d if first else 0
    return rows.where(F.size("embedding") == d), d


def cells_of(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, d)


def packed(rows: DataFrame, d: int) -> DataFrame:
    """n, kind, cells: blocks of vectors as whole numbers of the fewest bytes that hold them."""
    most = max(BLOCK_CELLS // d, 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = cells_of(batch.column(0), d)
            for at in range(0, len(whole), most):
                part = whole[at:at + most]
                small = np.result_type(np.int16, np.min_scalar_type(part.min()), np.min_scalar_type(-part.max() - 1))
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([small.str]), pa.array([part.astype(small).tobytes()], pa.binary())], ["n", "kind", "cells"])

    return rows.select("embedding").mapInArrow(work, "n long, kind string, cells binary")


def blocks_in(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, cells in zip(batch.column(1), batch.column(2)):
            yield np.frombuffer(cells.as_buffer(), dtype=kind.as_py()).reshape(-1, d)


def summed(blocks: DataFrame, d: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of ``part(block)``, ``size`` numbers. A task adds up its own; the rest is one row per number and task."""
    def work(batches):
        total = np.zeros(size)
        for cells in blocks_in(batches, d):
            total += part(cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["at", "value"])

    rows = blocks.mapInArrow(work, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def space_of(blocks: DataFrame, d: int) -> Space:
    def work(batches):
        n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for cells in blocks_in(batches, d):
            cells = cells.astype(np.int64)
            n, low, high = n + len(cells), low + (cells & LOW).sum(axis=0), high + (cells >> 26).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1), pa.int32()), pa.array(np.append(low, n)), pa.array(np.append(high, 0))], ["at", "low", "high"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = blocks.mapInArrow(work, "at int, low long, high long").groupBy("at").agg(wide("low"), wide("high")).orderBy("at").collect()  # d + 1 rows
    whole = [(int(r.high) << 26) + int(r.low) for r in rows]
    return Space(whole[-1], whole[:-1]) if whole else Space(0, [])


def orthogonal(q: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    for _ in range(2 if to else 0):
        basis = np.array(to)
        q = q - basis.T @ (basis @ q)
    return q


def bidiagonalised(product: Callable[[np.ndarray], tuple[np.ndarray, float]], d: int, norm: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) with X V = U B for orthonormal V and U, by ``product(g)`` = (X'(X g), |X g|^2). ``norm``: of X (Frobenius)."""
    draw = np.random.default_rng(seed)
    none = norm * d * 1e-14
    right, ways, images, bands = [], [], [], np.zeros((d, d))
    q = draw.normal(size=d)
    beta = 0.0
    while len(right) < d:
        if beta <= none:
            beta, q = 0.0, orthogonal(draw.normal(size=d), right)
        v = orthogonal(q / np.linalg.norm(q), right)
        v /= np.linalg.norm(v)
        j = len(right)
        right.append(v)
        g = v - beta * ways[-1] if beta else v
        image, square = product(g)                       # X'p and |p|^2 of p = X g
        if ways:
            along = np.array(ways) @ image               # U'p
            g, image = g - along @ np.array(ways), image - along @ np.array(images)
            square -= along @ along
        alpha = np.sqrt(max(square, 0.0))
        if j:
            bands[j - 1, j] = beta
        if alpha <= none:
            alpha, way, image = 0.0, np.zeros(d), np.zeros(d)
        else:
            way, image = g / alpha, image / alpha        # u = X way, X'u
        bands[j, j] = alpha
        ways.append(way), images.append(image)
        q = orthogonal(image - alpha * v, right)
        beta = np.linalg.norm(q)
    return np.array(right).T, bands


@dataclass(frozen=True)
class Whitening:
    """Components as columns, of unit length, with the eigenvalues of the covariance, largest first."""

    space: Space
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def fit(blocks: DataFrame, d: int, most: int = COMPONENTS) -> Whitening:
    """Components of the vectors in ``blocks``, at most ``most``; a direction without variance is none."""
    space = space_of(blocks, d)
    norm = np.sqrt(summed(blocks, d, 1, lambda cells: np.array([np.square(space.centred(cells)).sum()]))[0]) if space.n else 0.0
    if not norm:
        return Whitening(space, np.zeros((d, 0)), np.zeros(0), np.zeros(0))

    def product(g):
        def part(cells):
            x = space.centred(cells)
            p = x @ g
            return np.append(x.T @ p, p @ p)

        out = summed(blocks, d, d + 1, part)
        return out[:-1], out[-1]

    v, bands = bidiagonalised(product, d, norm)
    _, sigma, turned = np.linalg.svd(bands)
    kept = min(most, int((sigma > norm * d * 1e-13).sum()))
    components = v @ turned[:kept].T
    components *= np.sign(components[np.abs(components).argmax(axis=0), np.arange(kept)])
    return Whitening(space, components, sigma[:kept] ** 2 / space.n, sigma[:kept] ** 2 / norm**2)


def identity_error(blocks: DataFrame, d: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(model.eigenvalues)
    turn = model.components / np.sqrt(model.eigenvalues)

    def part(cells):
        z = model.space.centred(cells) @ turn
        return np.append((z.T @ z).ravel(), z.sum(axis=0))

    out = summed(blocks, d, k * k + k, part) / model.space.n
    mean = out[k * k:]
    return float(np.abs(out[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def exact_squares(m: np.ndarray) -> list[str]:
    """Sum of squares of each row of whole numbers, exact, as decimal text."""
    if m.dtype == object or (len(m) and np.abs(m).max() >= 2**51):
        return [str(sum(int(c) ** 2 for c in row)) for row in m]
    high, low = m >> 26, m & LOW
    parts = [(a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low))]
    return [str((a << 52) + (b << 27) + c) for a, b, c in zip(*parts)]


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row per vector and component.

    Vectors that are null or hold a null or non-finite entry, or one too large for a long, are left out; so are those whose
    length is not the most frequent one. Every remaining row counts, repeated and null ids included. Directions without
    variance are no components: equal vectors, a single one or an empty table give no rows. A deviation of more than 38
    digits is null. Other columns are not read.
    """
    rows, d = of_common_length(valid(vectors))
    kind = "n long, deviation decimal(38,0), component int, whitened double, explained double, identity_error double"
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    order = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not d:
        return vectors.sparkSession.createDataFrame([], f"vec_id {id_type}, {kind}").select(*order)
    blocks = materialize(packed(rows, d))
    model = fit(blocks, d, most)
    if not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], f"vec_id {id_type}, {kind}").select(*order)
    error = identity_error(blocks, d, model)
    turn = model.components / np.sqrt(model.eigenvalues)
    space = model.space

    def work(batches):
        for batch in batches:
            m = space.times_n_centred(cells_of(batch.column(1), d))
            z = m.astype(float) / space.n @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact_squares(m), pa.string()), lists], ["vec_id", "deviation", "z"])

    spread = rows.select("vec_id", "embedding").mapInArrow(work, f"vec_id {id_type}, deviation string, z array<double>")
    shares = F.array(*[F.lit(float(s)) for s in model.explained])
    long = spread.select("vec_id", F.col("deviation").try_cast("decimal(38,0)").alias("deviation"), F.posexplode("z").alias("i", "whitened"))
    return long.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(space.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
