"""Product quantisation of vectors in whole numbers, with annular norm pruning.

A vector is cut into PARTS consecutive parts; each part position has a codebook of at most ENTRIES entries, which starts
as the parts of the vectors of smallest id and is moved ROUNDS times to the (floored) mean of what it is nearest to.

The nearest entry is found by norms.  A codebook's entries are sorted by norm.  By the triangle inequality an entry is no
closer to a part than their norms are to each other; so from the distance of the best entry so far, a binary search
gives the interval of norms (an annulus around the origin) in which an equal or a closer one can lie.  The search starts
at the entry of nearest norm and goes outward; only entries in the annulus are measured, exactly, and it narrows with
each better one.  Its ends are inclusive and widened by more than the rounding of the norms, so an entry at an equal
distance is never passed over and ties go to the lower index.

Each round is one scan of the vectors, which are written once as integers.  A task adds up the parts of each entry
and gives these sums once, at its end; the sums of all tasks are added by a small shuffle, and only
the new codebooks, ENTRIES vectors, reach the driver.

Defined cases: a row whose vector is null, or holds a null or non-finite component, is dropped; a row without an id stays, after
all others in the order of ids; repeated ids are ordered by their vectors; repeated rows each count and each give a row; with fewer than ENTRIES rows
the codebooks are smaller; vectors of another length have codebooks of their own; a length that PARTS does not divide is cut
as evenly as can be, and an empty vector has code 0 and error 0; components beyond a long's range are taken at its
ends, and errors saturate there; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvatica.llm.storage import discard, join_groups, settle
from sylvatica.llm.vectors import lengths, matrix, numbered

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
_LONG = 2**63 - 1
SUMS = "part int, entry int, place int, total decimal(38,0), n long"
CODES = "id long, label string, code string, error long"
#: How much an annulus is widened, in parts of the norms; their rounding is some 2 ** -50.
SLACK = 2.0**-40


def whole(column: str, scale: int) -> Column:
    """Components as the integers floor(scale * x)."""
    return F.transform(column, lambda x: F.floor(x.cast("double") * scale))


def cut(size: int, parts: int = PARTS) -> list[slice]:
    return [slice(size * i // parts, size * (i + 1) // parts) for i in range(parts)]


def exact(*matrices: np.ndarray) -> bool:
    """Whether squared distances between rows of these stay in a long."""
    most = sum(float(np.abs(m.astype(float)).max(initial=0.0)) for m in matrices)
    return most * most * max(1, matrices[0].shape[1]) < 2.0**62


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(float) ** 2).sum(axis=1))


class Annuli:
    """A codebook (entries by dimensions) sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        size = norms(entries)
        self.entries, self.order = entries, np.lexsort((np.arange(len(entries)), size))
        self.norms = size[self.order]
        self.measured = 0  # distances, for tests

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance to it) of each row of ``parts``."""
        entries = self.entries
        if not exact(parts, entries):
            parts, entries = parts.astype(object), entries.astype(object)

        def distance(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
            self.measured += len(rows)
            return ((parts[rows] - entries[self.order[places]]) ** 2).sum(axis=1)

        own, every = norms(parts), np.arange(len(parts))
        slack = SLACK * (own + self.norms[-1] + 1)
        at = np.clip(np.searchsorted(self.norms, own), 0, len(entries) - 1)
        index, best = self.order[at], distance(every, at)

        def annulus(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            reach = np.sqrt(best[rows].astype(float)) + slack[rows]
            return np.searchsorted(self.norms, own[rows] - reach, "left"), np.searchsorted(self.norms, own[rows] + reach, "right")

        low, high = annulus(every)
        for step in range(1, len(entries)):
            for place in (at - step, at + step):
                rows = np.flatnonzero((place >= low) & (place < high))
                if not len(rows):
                    continue
                found, entry = distance(rows, place[rows]), self.order[place[rows]]
                better = ((found < best[rows]) | ((found == best[rows]) & (entry < index[rows]))).astype(bool)
                rows = rows[better]
                best[rows], index[rows] = found[better], entry[better]
                low[rows], high[rows] = annulus(rows)
        return index, best


def _sums(books: list[np.ndarray], size: int):
    """Per task: the sum and number of the parts nearest to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, places = [Annuli(b) for b in books], cut(size)
        totals = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            vectors = matrix(batch.column(0), size)
            for at, total, count, place in zip(annuli, totals, counts, places, strict=True):
                part = vectors[:, place]
                index, _ = at.nearest(part)
                order = np.argsort(index, kind="stable")
                seen, first = np.unique(index[order], return_index=True)
                if not len(seen):
                    continue
                small = float(np.abs(part.astype(float)).max(initial=0.0)) * len(part) < 2.0**62
                total[seen] += np.add.reduceat(part[order] if small else part[order].astype(object), first, axis=0).astype(object)
                count += np.bincount(index, minlength=len(count))
        rows = [(p, e, i, Decimal(int(totals[p][e, i])), int(counts[p][e])) for p in range(PARTS) for e in np.flatnonzero(counts[p]) for i in range(totals[p].shape[1])]
        if rows:
            part_, entry, place_, total_, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part_, pa.int32()), pa.array(entry, pa.int32()), pa.array(place_, pa.int32()), pa.array(total_, pa.decimal128(38, 0)), pa.array(n, pa.int64())], names=[c.split()[0] for c in SUMS.split(", ")])

    return run


def codebooks(rows: DataFrame, size: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of the part positions, of rows (id, v) whose vectors all have ``size`` components."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), size)
    books = [start[:, place].copy() for place in cut(size)]
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(_sums(books, size), SUMS).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in sums.collect():  # a codebook's components
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    """Of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def _code(books: list[np.ndarray], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, places = [Annuli(b) for b in books], cut(size)
        for batch in batches:
            vectors = matrix(batch.column(2), size)
            codes, error = np.zeros((len(vectors), PARTS), np.uint8), np.zeros(len(vectors), object)
            for p in range(PARTS):
                index, distance = annuli[p].nearest(vectors[:, places[p]])
                codes[:, p] = index
                error += distance.astype(object)
            told, width = codes.tobytes().hex(), 2 * PARTS
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([told[i : i + width] for i in range(0, len(told), width)], pa.string()), pa.array([min(int(e), _LONG) for e in error], pa.int64())], names=[c.split()[0] for c in CODES.split(", ")])

    return run


def quantise(vectors: DataFrame, identifier: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """The code of every finite vector: vec_id, code (two hex digits a part), error (of its code), label_error (summed
    over the rows of its label; those without one are together), codebooks_sha256."""
    name = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null")).alias("label")
    rows = numbered(vectors, identifier, whole(column, SCALE), column, "components", name)
    coded = None
    for size in lengths(rows):
        own = rows.where(F.col("size") == size)
        books = codebooks(own, size)
        made = own.select("id", "label", "v").mapInArrow(_code(books, size), CODES).withColumn("codebooks_sha256", F.lit(digest(books)))
        coded = made if coded is None else coded.unionByName(made)
    if coded is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = settle(coded, "codes")
    discard(rows)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    labels = settle(coded.groupBy("label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("__rows")), "labels")
    told = join_groups(coded, labels, ["label"], "__rows", coded.count())
    return told.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
