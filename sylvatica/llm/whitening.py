"""Whitening of vectors by their leading principal components, found by a matrix-free block Lanczos method.

Components are the integers x = floor(SCALE * c) + OFFSET.  With n vectors and sums S, a vector's centred form is
x - S / n = (x - q) - r / n for S = q * n + r: the first term is a whole number and the second is below one, so
centring loses no digit to the offset, and the deviation, the sum of (n * x - S) ** 2, comes from whole numbers.

No covariance matrix is made.  A pass sends a block of orthonormal directions Q to the tasks; each multiplies its centred
vectors, Z' (Z Q), and gives its sum once; the sums of all tasks make V Q for the covariance V.  What is new
in V Q, orthogonalised twice against all directions so far, is the next block (full reorthogonalisation); directions that
vanish (breakdown: the Krylov space is invariant) are started again at random, orthogonal to the rest.  The Ritz pairs
of the space come from the directions and their images alone, and their residuals |V u - e u| decide: passes end when all
wanted ones are within TOLERANCE of the largest eigenvalue, or when the space is the whole one.  A space of more than
BASIS directions is compressed to its best Ritz vectors.  Driver and tasks hold some BASIS vectors at most.

The trace comes from the deviations (their sum over n ** 3), and the identity error from one more pass over the whitened rows.

Defined cases: a row whose vector is null, or holds a null or non-finite component, is dropped; rows without an id, repeated ids
and repeated rows all count and each give rows; components of eigenvalue 0 (at most RANK of the largest: no spread, as with
one row or fewer rows than dimensions) cannot be whitened and give no rows; of equal eigenvalues any orthonormal basis is taken;
vectors of another length are a fit list of their own; deviations saturate at a long's ends; components beyond 2 ** 53
are taken at that end; an empty vector, and an empty table, give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvatica.llm.vectors import lengths, matrix, numbered

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Directions of a pass, and of a space before it is compressed.
BLOCK = 16
BASIS = 512
#: Residuals that count as none, and eigenvalues that count as zero, both as parts of the largest eigenvalue.
TOLERANCE = 2.0**-46
RANK = 2.0**-44
PASSES = 400
_LONG = 2**63 - 1
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

Multiply = Callable[[np.ndarray], np.ndarray]


def whole(column: str) -> Column:
    most = 1 << 53

    def component(x: Column) -> Column:
        return F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x.cast("double") * SCALE))) + OFFSET

    return F.transform(column, component)


@dataclass(frozen=True)
class Centre:
    """n and the sums of each dimension as whole multiples of n and remainders."""

    n: int
    quotient: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.quotient).astype(float) - self.rest / self.n

    def deviations(self, vectors: np.ndarray) -> list[int]:
        """The sum of (n * x - S) ** 2 of each vector, exact."""
        apart = vectors - self.quotient
        most = (float(np.abs(apart).max(initial=0)) + 1) * self.n
        if most * most * max(1, vectors.shape[1]) < 2.0**62:
            return ((apart * self.n - self.rest) ** 2).sum(axis=1).tolist()
        return [int(d) for d in ((apart.astype(object) * self.n - self.rest) ** 2).sum(axis=1)]


def centre(rows: DataFrame, size: int) -> Centre:
    """Exact sums: a task gives its own once, as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(size, object), np.zeros(size, object)
        for batch in batches:
            vectors = matrix(batch.column(0), size)
            n += len(vectors)
            low += (vectors & 0xFFFFFFFF).sum(axis=0).astype(object)  # in halves, so that no batch passes a long's range
            high += (vectors >> 32).sum(axis=0).astype(object)
        sums = [Decimal(int(h) << 32) + int(s) for h, s in zip(high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(sums, pa.decimal128(38, 0)), pa.array([n] * size, pa.int64())], names=["i", "total", "n"])

    sums = rows.select("v").mapInArrow(run, "i int, total decimal(38,0), n long").groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    found = sorted(sums.collect())  # a vector
    return Centre.of(found[0]["n"], [int(r["total"]) for r in found])


def _summed(rows: DataFrame, size: int, shape: tuple[int, int], partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of ``partial`` (a matrix of ``shape``), by task and then by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += partial(matrix(batch.column(0), size))
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

    cells = rows.select("v").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(shape)
    for cell, value in cells.collect():  # as many numbers as the matrix has
        out.flat[cell] = value
    return out


def covariance_times(rows: DataFrame, size: int, about: Centre) -> Multiply:
    """V Q for a block Q of directions: one pass over the rows."""

    def multiply(directions: np.ndarray) -> np.ndarray:
        def partial(vectors: np.ndarray) -> np.ndarray:
            apart = about.centred(vectors)
            return apart.T @ (apart @ directions)

        return _summed(rows, size, directions.shape, partial) / about.n

    return multiply


def fresh_directions(basis: np.ndarray, block: np.ndarray, width: int, scale: float, random: np.random.Generator) -> np.ndarray:
    """At most ``width`` orthonormal directions, orthogonal to ``basis``: those of ``block``, then random ones."""
    size = len(basis)
    made = np.zeros((size, 0))
    given = list(block.T)
    room = min(width, size - basis.shape[1])
    while made.shape[1] < room:
        broken = not given
        column = random.standard_normal(size) if broken else given.pop(0)
        least = (1.0 if broken else scale) * 2.0**-40
        known = np.hstack((basis, made))
        for _ in range(3):
            column = column - known @ (known.T @ column)
        if (length := np.linalg.norm(column)) > least:
            column = column / length
            column = column - known @ (known.T @ column)
            made = np.hstack((made, (column / np.linalg.norm(column))[:, None]))
    return made


def block_lanczos(multiply: Multiply, size: int, wanted: int, block: int = BLOCK, most: int = BASIS, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of the ``wanted`` largest eigenvalues of a symmetric matrix
    that only ``multiply`` knows."""
    wanted = min(wanted, size)
    random = np.random.default_rng(seed)
    basis, images = np.zeros((size, 0)), np.zeros((size, 0))
    block = max(1, min(block, size))
    most = max(most, wanted + 2 * block)
    new = fresh_directions(basis, np.zeros((size, 0)), block, 1.0, random)
    for _ in range(PASSES):
        image = multiply(new)
        basis, images = np.hstack((basis, new)), np.hstack((images, image))
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        scale = max(float(np.abs(values).max()), np.finfo(float).tiny)
        if basis.shape[1] >= wanted:
            vectors = basis @ turn[:, :wanted]
            residual = np.linalg.norm(images @ turn[:, :wanted] - vectors * values[:wanted], axis=0)
            if basis.shape[1] == size or float(residual.max(initial=0.0)) <= TOLERANCE * scale:
                return values[:wanted], vectors / np.linalg.norm(vectors, axis=0)
        left = image - basis @ (basis.T @ image)
        new = fresh_directions(basis, left, block, scale, random)
        if basis.shape[1] + new.shape[1] > most:
            keep = turn[:, : wanted + block]
            basis, images = basis @ keep, images @ keep
    raise RuntimeError(f"no convergence in {PASSES} passes")


@dataclass(frozen=True)
class Whitening:
    """What turns a vector into ``values.size`` whitened components."""

    about: Centre
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @property
    def turn(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of rows (v) whose vectors all have ``size`` components; there must be rows."""
    about = centre(rows, size)
    values, vectors = block_lanczos(covariance_times(rows, size, about), size, components)
    n = about.n

    def spread(matrix_: np.ndarray) -> np.ndarray:
        return np.array([[sum(d / n / n for d in about.deviations(matrix_)) / n]])

    trace = float(_summed(rows, size, (1, 1), spread)[0, 0])
    kept = values > RANK * max(float(values.max(initial=0.0)), 0.0)
    values, vectors = values[kept], vectors[:, kept]
    turn = vectors / np.sqrt(values)
    wide = turn.shape[1]
    if not wide:
        return Whitening(about, values, vectors, trace, 0.0)

    def gram(matrix_: np.ndarray) -> np.ndarray:
        made = about.centred(matrix_) @ turn  # of mean 0, as the centred vectors are
        return np.vstack((made.T @ made, made.sum(axis=0)))

    sums = _summed(rows, size, (wide + 1, wide), gram) / n
    error = float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(wide)).max())
    return Whitening(about, values, vectors, trace, error)


def apply(rows: DataFrame, size: int, by: Whitening) -> DataFrame:
    """A row for each vector and component."""
    turn, about, wide = by.turn, by.about, len(by.values)
    explained = by.values / by.trace if by.trace else by.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if wide else 0, 1024):
                some = batch.slice(at, 1024)
                vectors = matrix(some.column(1), size)
                count = len(vectors)
                deviation = pa.array([min(d, _LONG) for d in about.deviations(vectors)], pa.int64())
                each = pa.array(np.repeat(np.arange(count), wide))
                made = [
                    some.column(0).take(each), pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), count)), pa.array(np.full(count * wide, about.n)), deviation.take(each),
                    pa.array((about.centred(vectors) @ turn).ravel()), pa.array(np.tile(explained, count)), pa.array(np.full(count * wide, by.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in WHITENED.split(", ")])

    return rows.select("id", "v").mapInArrow(run, WHITENED)


def whiten(vectors: DataFrame, identifier: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every finite vector."""
    rows = numbered(vectors, identifier, whole(column), column, "components")
    made = None
    for size in lengths(rows):
        if size:
            own = rows.where(F.col("size") == size)
            one = apply(own, size, fit(own, size, components))
            made = one if made is None else made.unionByName(one)
    return rows.sparkSession.createDataFrame([], WHITENED) if made is None else made
