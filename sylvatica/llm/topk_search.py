"""Exact top-k inner-product search over vector-approximation files.

Components are the integers floor(1024 * x).  The vectors are written once as approximations: a block of some
thousand vectors of one length and like magnitude keeps, per dimension, the block's range in 2 ** BITS equal cells,
and of every vector the numbers of its cells, a byte each.  A search scans these files alone.  With a vector taken
at the middle of its cells, one product of matrices gives the scores of a block for a block of queries within a
distance that depends on the query only (half a cell's width in every dimension, and the rounding of the product).
A vector goes on if its upper bound reaches the k-th largest lower bound that the task has seen; once all blocks
are scanned, if it reaches that of the whole table.  Only the vectors that are left are read exactly, for each
query in the order of their upper bounds, until the k-th score is above the next bound.

Equal vectors have equal scores, of which only the smallest ids can be answers; so a vector that repeats, however
often, is searched as its 2 * k smallest rows (of which at most k can be a query's own, as an id counts k times at
most).  That is a window with a limit on both sides of its shuffle, and no task meets all copies.

Queries are sent to the tasks some MB at a time (QUERY_BYTES, whatever the query set), so the approximations are
scanned once per so many queries.  A first scan of one block in FIRST gives each query a bar that
all tasks begin with, so that what they write does not grow with their number.  A task holds one block, the queries sent, and k bounds per query.

Defined cases: a vector that is null, or that holds a null or non-finite component, and a row without an id take no
part; an empty vector does, and its score with another is 0; a query is compared with vectors of its own length
only; a query is answered once however often its row is repeated (by its smallest vector), and no row with its id is
a candidate; repeated candidate rows each take a rank; ties go to the smaller id; very large components only widen
the cells of blocks of their own magnitude; an empty table, or a query without candidates, gives no rows; scores
saturate at a long's ends; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvatica.llm.storage import discard, fresh_path, settle

SCALE = 1024
BITS = 8
#: Vectors of a block of approximations, and queries that are bounded against it at once.
VECTOR_BLOCK = 2048
QUERY_BLOCK = 1024
#: One block in so many is scanned first, for bars that all tasks begin with.
FIRST = 64
#: Bytes of queries that a scan answers.
QUERY_BYTES = 8 << 20
_LONG = 2**63 - 1
CELLS = "size int, row binary, id binary, low binary, width binary, cells binary"
BOUNDS = "query_id long, row long, lower double, upper double"
FOUND = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, identifier: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, components) of the rows that take part, as integers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(column, lambda x: F.floor(x.cast("double") * SCALE))
    kept = vectors.where(F.col(identifier).isNotNull() & F.col(column).isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(identifier).cast("long").alias("id"), whole.alias("v"))


class Grid:
    """Equal cells of each dimension of a block: ``low`` is the first one's edge, ``reach`` how far a component can be
    from the middle of its cell and ``most`` its largest size."""

    def __init__(self, low: np.ndarray, width: np.ndarray, bits: int) -> None:
        self.low, self.width = low, width
        self.most = np.maximum(np.abs(low), np.abs(low + width * (1 << bits)))
        self.reach = width * (0.5 + 2.0**-20) + self.most * 2.0**-48

    @classmethod
    def of(cls, vectors: np.ndarray, bits: int) -> Grid:
        low, high = vectors.min(axis=0).astype(float), vectors.max(axis=0).astype(float)
        return cls(low, (high - low) * (1 + 2.0**-30) / (1 << bits), bits)

    def cells(self, vectors: np.ndarray, bits: int) -> np.ndarray:
        at = (vectors.astype(float) - self.low) / np.where(self.width > 0, self.width, 1.0)
        return np.clip(np.floor(at), 0, (1 << bits) - 1).astype(np.uint8)

    def scores(self, cells: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a score of each query and vector, how far a query's true scores can be from it)."""
        size = np.abs(queries) @ self.most
        kind = np.float32 if float(size.max(initial=0.0)) < 1e30 else np.float64
        middle = (self.low + (cells + 0.5) * self.width).astype(kind)
        rounding = (len(self.low) + 16) * 2.0 ** (-22 if kind is np.float32 else -51)
        return queries.astype(kind) @ middle.T, np.abs(queries) @ self.reach + size * rounding


def magnitude(vectors: np.ndarray) -> np.ndarray:
    """The largest component of each vector as a power of four."""
    most = np.abs(vectors.astype(float)).max(axis=1, initial=0.0)
    return np.where(most > 0, np.frexp(most)[1] // 2, -1)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in an Arrow column of lists."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(ends)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, flat[ends[rows][:, None] + np.arange(size)]))
    return out


def _approximate(bits: int):
    """Blocks of approximations of rows (row, id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, ids = (batch.column(i).to_numpy() for i in (0, 1))
            for rows, matrix in _matrix(batch.column(2)):
                kinds = magnitude(matrix)
                for kind in np.unique(kinds):
                    alike = np.flatnonzero(kinds == kind)
                    for at in range(0, len(alike), VECTOR_BLOCK):
                        own = alike[at : at + VECTOR_BLOCK]
                        grid = Grid.of(matrix[own], bits)
                        made = (numbers[rows[own]], ids[rows[own]], grid.low, grid.width, grid.cells(matrix[own], bits))
                        yield pa.RecordBatch.from_arrays([pa.array([matrix.shape[1]], pa.int32()), *[pa.array([np.ascontiguousarray(m).tobytes()], pa.binary()) for m in made]], names=[c.split()[0] for c in CELLS.split(", ")])

    return run


class Bars:
    """The k largest lower bounds of each query so far; a vector whose upper bound is under the least of them is out, or under
    ``floor``, which k vectors of the first scan are known to reach."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None) -> None:
        self.best = np.full((queries, k), -np.inf)
        self.floor = np.full(queries, -np.inf) if floor is None else floor

    def meet(self, first: int, lower: np.ndarray) -> np.ndarray:
        """Take in a block's lower bounds for the queries from ``first`` on; returns their bars."""
        own = self.best[first : first + len(lower)]
        k = own.shape[1]
        higher = np.flatnonzero((lower > own[:, :1]).any(axis=1))
        if len(higher):
            new = lower[higher]
            if new.shape[1] > k:
                new = np.partition(new, new.shape[1] - k, axis=1)[:, -k:]
            own[higher] = np.sort(np.concatenate((own[higher], new), axis=1), axis=1)[:, -k:]
        return np.maximum(own[:, 0], self.floor[first : first + len(lower)])


def bounded(cells: np.ndarray, grid: Grid, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bars: Bars, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, lower, upper) of the pairs of a block that a block of queries cannot rule out yet."""
    score, reach = grid.scores(cells, queries)
    lower = np.clip(score - reach[:, None], -(2.0**63), 2.0**63)  # as scores saturate, bounds do
    upper = np.clip(score + reach[:, None], -(2.0**63), 2.0**63)
    own = query_ids[:, None] == ids[None, :]
    lower[own] = upper[own] = -np.inf
    bar = bars.meet(first, lower)
    q, v = np.nonzero((upper >= bar[:, None]) & (upper > -np.inf))
    return q, v, lower[q, v], upper[q, v]


def _scan(sent, k: int, bits: int, floors=None):
    """The pairs that a task's blocks leave for the queries sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        bars = {size: Bars(len(ids), k, None if floors is None else floors.value[size]) for size, (ids, _) in asked.items()}
        for batch in batches:
            for size, row, id_, low, width, cells in zip(*batch.columns, strict=True):
                size = size.as_py()
                if size not in asked:
                    continue
                query_ids, queries = asked[size]
                rows, ids = np.frombuffer(row.as_buffer(), np.int64), np.frombuffer(id_.as_buffer(), np.int64)
                grid = Grid(np.frombuffer(low.as_buffer()), np.frombuffer(width.as_buffer()), bits)
                block = np.frombuffer(cells.as_buffer(), np.uint8).reshape(len(rows), size)
                for at in range(0, len(query_ids), QUERY_BLOCK):
                    own = query_ids[at : at + QUERY_BLOCK]
                    q, v, lower, upper = bounded(block, grid, ids, own, queries[at : at + QUERY_BLOCK], bars[size], at)
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(rows[v]), pa.array(lower), pa.array(upper)], names=["query_id", "row", "lower", "upper"])

    return run


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> list[int]:
    """Inner products as whole numbers, saturating at a long's ends."""
    limit = float(np.abs(query.astype(float)).max(initial=0.0)) * float(np.abs(vectors.astype(float)).max(initial=0.0)) * max(1, len(query))
    if limit < 2.0**62:
        return (vectors @ query).tolist()
    return [max(-_LONG - 1, min(_LONG, sum(int(a) * int(b) for a, b in zip(query, v, strict=True)))) for v in vectors]


def _read(k: int):
    """The k best of each query from rows (query_id, q, id, v, upper) sorted by query and falling upper bound."""

    def best(query: int, rows: list[dict]) -> list[tuple[int, int, int]]:
        asked = np.array(rows[0]["q"], np.int64)
        top: list[tuple[int, int]] = []  # (-score, id)
        for at in range(0, len(rows), 4 * k):
            some = rows[at : at + 4 * k]
            if len(top) == k and some[0]["upper"] < -top[-1][0]:
                break  # no vector that is left can reach the k-th score
            vectors = np.array([r["v"] for r in some], np.int64).reshape(len(some), len(asked))
            top = sorted(top + [(-s, r["id"]) for s, r in zip(exact_scores(asked, vectors), some, strict=True)])[:k]
        return [(query, i, -s) for s, i in top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

        held: list[dict] = []  # the rows of one query
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for row in batch.to_pylist():
                if held and row["query_id"] != held[0]["query_id"]:
                    found += best(held[0]["query_id"], held)
                    held = []
                held.append(row)
                if len(held) > 64 * k:  # what cannot be an answer any more goes
                    kept = {(i, s) for _, i, s in best(row["query_id"], held)}
                    scores = exact_scores(np.array(row["q"], np.int64), np.array([r["v"] for r in held], np.int64).reshape(len(held), len(row["q"])))
                    held = [r for r, s in zip(held, scores, strict=True) if (r["id"], s) in kept]
            if found:
                yield told(found)
        if held:
            yield told(best(held[0]["query_id"], held))

    return run


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(row, id, v): of equal vectors the rows that any query could be answered with."""
    alike = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    same = Window.partitionBy(F.xxhash64("v"), "v", "id").orderBy(F.lit(1))
    few = vectors.select("id", "v").withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= k)
    kept = few.withColumn("__n", F.row_number().over(alike)).where(F.col("__n") <= 2 * k)
    return settle(kept.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "vectors")


def _kth(bounds: DataFrame, k: int) -> DataFrame:
    """(query_id, bar: the k-th largest lower bound, n: how many there are up to k)."""
    order = Window.partitionBy("query_id").orderBy(F.col("lower").desc())
    return bounds.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).groupBy("query_id").agg(F.min("lower").alias("bar"), F.count(F.lit(1)).alias("n"))


def _floors(cells: DataFrame, sent, k: int, bits: int) -> dict[int, np.ndarray]:
    """For the queries sent, what the k best of one block in FIRST reach.  So the bounds that all tasks write for a query
    are about FIRST times k, however many tasks there are."""
    first = cells.where(F.pmod(F.xxhash64("row"), F.lit(FIRST)) == 0).mapInArrow(_scan(sent, k, bits), BOUNDS)
    known = {r["query_id"]: r["bar"] for r in _kth(first, k).where(F.col("n") == k).collect()}  # a number for each query sent
    return {size: np.array([known.get(i, -np.inf) for i in ids.tolist()]) for size, (ids, _) in sent.value.items()}


def candidates(rows: DataFrame, asked: DataFrame, k: int, bits: int = BITS) -> DataFrame:
    """(query_id, row, lower, upper) of the pairs that the approximations alone leave open for the k best."""
    spark = rows.sparkSession
    cells = settle(rows.mapInArrow(_approximate(bits), CELLS), "cells")
    figures = asked.agg(F.count(F.lit(1)), F.sum(F.size("v") + 2)).first()
    scans = -(-(figures[1] or 0) * 8 // QUERY_BYTES)
    path = fresh_path(spark, "bounds")
    spark.createDataFrame([], BOUNDS).write.parquet(path)
    for scan in range(scans):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(scans)) == scan).collect()  # about QUERY_BYTES
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(r["v"]) for r in some}:
            same = [r for r in some if len(r["v"]) == size]
            by_size[size] = np.array([r["id"] for r in same], np.int64), np.array([r["v"] for r in same], float).reshape(len(same), size)
        sent = spark.sparkContext.broadcast(by_size)
        floors = spark.sparkContext.broadcast(_floors(cells, sent, k, bits))
        cells.mapInArrow(_scan(sent, k, bits, floors), BOUNDS).write.mode("append").parquet(path)
        sent.destroy()
        floors.destroy()
    discard(cells)
    bounds = spark.read.schema(BOUNDS).parquet(path)
    bars = _kth(bounds, k).select("query_id", F.when(F.col("n") == k, F.col("bar")).otherwise(F.lit(float("-inf"))).alias("bar"))
    return bounds.join(bars, "query_id").where(F.col("upper") >= F.col("bar")).select("query_id", "row", "lower", "upper")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS) -> DataFrame:
    """The k best of ``vectors`` for each of ``queries`` (both as ``usable`` gives them):
    query_id, rank, vec_id, score."""
    if not 1 <= bits <= 8:
        raise ValueError("a cell's number is a byte")
    asked = settle(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    rows = distinct_vectors(vectors, k)
    left = settle(candidates(rows, asked, k, bits), "candidates")
    # few rows beside the vectors: where they are few enough to be sent, the vectors stay where they are
    read = left.join(rows, "row").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    ordered = read.select("query_id", "q", "id", "v", "upper").repartition("query_id").sortWithinPartitions("query_id", F.col("upper").desc())
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = ordered.mapInArrow(_read(k), FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
