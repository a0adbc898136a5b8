"""Approximate nearest neighbours through learned partitions.

Fitting, on a bounded sample of rows: the graph of each distinct vector's nearest neighbours in the sample is cut into parts
of equal size by recursive bisection (each half by the median of the graph's slowest diffusion mode, then by swaps
that cut fewer edges), and a small network with one hidden layer learns to tell the parts of a vector and of its neighbours.

Indexing: every row of the table goes to the part that the network finds most probable.

Routing: a query is compared with the rows of its ``probes`` most probable parts.  How many these are is measured, not
set: for some rows outside the sample the true neighbours among all rows are found by one scan, and the least
number of parts that holds TARGET of them is taken (up to all parts, where a search is exact).

Searching: the rows of a part are dealt over shards of bounded size, and so are the queries, so no task meets a whole part however
many rows or copies it holds.  A shard of rows and a shard of queries meet in one group: a product of matrices bounds all distances,
and those that can be among a query's k nearest are then measured as the root of the summed squares of differences.  Each group gives
at most k rows a query, of which the k nearest stay.

Defined cases: a vector that is null, zero, or holds a null or non-finite component, and a row without an id take no part; a query is
compared with vectors of its own length only; a query is answered once however often its row is repeated (by its
smallest vector), and no row with its id is a candidate; repeated candidate rows each take a rank; ties go to the smaller
id; distances beyond a double's range are taken at its end; an empty table, or a query without candidates, gives no rows;
columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvatica.llm.storage import settle
from sylvatica.llm.vectors import lengths, matrix, numbered

#: Rows that a model is fitted on (fewer, if they are wide) and rows that tell how many parts to search.
SAMPLE = 8192
SAMPLE_BYTES = 32 << 20
CHECKS = 512
#: Parts at most, and distinct vectors of the sample that a part has at least.
PARTS = 64
PART_ROWS = 128
NEIGHBOURS = 10
#: Share of the true neighbours that the parts searched must hold.
TARGET = 0.95
HIDDEN = 64
EPOCHS = 20
#: Bytes of vectors of a shard at most; and shards that a table is dealt over at least, if these have LEAST_ROWS rows.
SHARD_BYTES = 32 << 20
SHARDS = 256
LEAST_ROWS = 512
#: Queries and rows of a product of matrices.
QUERY_BLOCK = 256
ROW_BLOCK = 2048
_MOST = np.finfo(float).max
NEAREST = "query_id long, vec_id long, score double, tag long"
FOUND = "query_id long, vec_id long, score double"


class Nearest:
    """The k nearest rows of each of some queries so far, by distance and then by id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        with np.errstate(over="ignore"):
            self.square = (queries**2).sum(axis=1)
        self.distance = np.full((len(ids), k), np.inf)  # infinite where there is none yet
        self.found, self.tag = (np.zeros((len(ids), k), np.int64) for _ in range(2))

    def offer(self, ids: np.ndarray, rows: np.ndarray, tags: np.ndarray) -> None:
        for at in range(0, len(rows), ROW_BLOCK):
            some = slice(at, at + ROW_BLOCK)
            with np.errstate(over="ignore", invalid="ignore"):
                for first in range(0, len(self.ids), QUERY_BLOCK):
                    self._meet(slice(first, first + QUERY_BLOCK), ids[some], rows[some], tags[some])

    def _meet(self, own: slice, ids: np.ndarray, rows: np.ndarray, tags: np.ndarray) -> None:
        queries, k = self.queries[own], self.k
        size = self.square[own, None] + (rows**2).sum(axis=1)
        middle, reach = size - 2 * (queries @ rows.T), size * ((queries.shape[1] + 16) * 2.0**-50)
        low, high = middle - reach, middle + reach
        low[~np.isfinite(low)], high[~np.isfinite(high)] = -np.inf, np.inf
        same = self.ids[own, None] == ids
        high[same] = np.inf
        bar = self.distance[own, -1] ** 2 * (1 + 2.0**-48)
        if len(rows) >= k:
            bar = np.minimum(bar, np.partition(high, k - 1, axis=1)[:, k - 1])
        q, r = np.nonzero((low <= bar[:, None]) & ~same)
        if not len(q):
            return
        step, exact = max(1, (8 << 20) // (8 * max(1, rows.shape[1]))), np.empty(len(q))
        for at in range(0, len(q), step):
            exact[at : at + step] = np.sqrt(((queries[q[at : at + step]] - rows[r[at : at + step]]) ** 2).sum(axis=1))
        touched = np.unique(q)
        held = np.isfinite(self.distance[own][touched])
        owner = np.concatenate((q, np.repeat(touched, held.sum(axis=1))))
        distance = np.concatenate((np.minimum(exact, _MOST), self.distance[own][touched][held]))
        found = np.concatenate((ids[r], self.found[own][touched][held]))
        tag = np.concatenate((tags[r], self.tag[own][touched][held]))
        order = np.lexsort((found, distance, owner))
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        order, owner, place = order[place < k], owner[place < k], place[place < k]
        for kept, values in ((self.distance, distance), (self.found, found), (self.tag, tag)):
            kept[own][owner, place] = values[order]

    def told(self) -> pa.RecordBatch:
        q, place = np.nonzero(np.isfinite(self.distance))
        made = (self.ids[q], self.found[q, place], self.distance[q, place], self.tag[q, place])
        return pa.RecordBatch.from_arrays([pa.array(m) for m in made], names=[c.split()[0] for c in NEAREST.split(", ")])


# --- fitting ---------------------------------------------------------------------------------------------------


def neighbour_graph(spark, vectors: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """(from, to) of the edges between each vector of a sample and its nearest others; tasks take slices of the sample."""
    sent = spark.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(sent.value))
        for batch in batches:
            own = batch.column(0).to_numpy()
            best = Nearest(own, sent.value[own], k)
            best.offer(every, sent.value, every)
            yield best.told()

    slices = spark.range(0, len(vectors), 1, max(1, len(vectors) // 512))
    edges = slices.mapInArrow(run, NEAREST).select("query_id", "vec_id").toArrow()  # k a vector of the sample
    sent.destroy()
    pairs = np.stack([edges.column(i).to_numpy() for i in (0, 1)], axis=1)
    return pairs[np.lexsort(pairs.T)]


def _bisect(count: int, edges: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Which of ``count`` nodes are in the second half; halves differ by one node at most."""
    a, b = np.concatenate((edges, edges[:, ::-1])).T
    degree = np.bincount(a, minlength=count) + 1.0
    mode = random.standard_normal(count)
    for _ in range(60):  # diffusion, without its constant mode
        mode = (mode + (np.bincount(a, mode[b], minlength=count) + mode) / degree) / 2
        mode -= (mode * degree).sum() / degree.sum()
        mode /= max(float(np.abs(mode).max()), np.finfo(float).tiny)
    second = np.zeros(count, bool)
    second[np.argsort(mode, kind="stable")[count // 2 :]] = True
    cut = np.count_nonzero(second[a] != second[b])
    for _ in range(20):  # swap the nodes that would leave most edges uncut, as long as it helps
        gain = np.bincount(a, np.where(second[a] != second[b], 1.0, -1.0), minlength=count)
        left, right = (np.flatnonzero(side)[np.argsort(-gain[side], kind="stable")] for side in (~second, second))
        most = min(len(left), len(right))
        swaps = np.count_nonzero(gain[left[:most]] + gain[right[:most]] > 0) // 2
        moved = second.copy()
        moved[left[:swaps]], moved[right[:swaps]] = True, False
        now = np.count_nonzero(moved[a] != moved[b])
        if now >= cut:
            break
        second, cut = moved, now
    return second


def balanced_parts(count: int, edges: np.ndarray, levels: int, seed: int = 12) -> np.ndarray:
    """A part, of 2 ** levels, for each node: sizes are equal but for rounding, and few edges are cut."""
    random, part = np.random.default_rng(seed), np.zeros(count, np.int64)
    for _ in range(levels):
        finer = part * 2
        for p in np.unique(part):
            members = np.flatnonzero(part == p)
            number = np.full(count, -1)
            number[members] = np.arange(len(members))
            inner = number[edges]
            finer[members] += _bisect(len(members), inner[(inner >= 0).all(axis=1)], random)
        part = finer
    return part


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer that tells how probable each part is for a vector."""

    mean: np.ndarray
    spread: np.ndarray
    first: np.ndarray
    second: np.ndarray

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            plain = np.clip(np.nan_to_num((vectors - self.mean) / self.spread), -1e3, 1e3)
        return np.hstack((plain, np.ones((len(plain), 1))))

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.inputs(vectors) @ self.first, 0.0)
        return np.hstack((hidden, np.ones((len(hidden), 1)))) @ self.second

    def ranked(self, vectors: np.ndarray) -> np.ndarray:
        """The parts of each vector, most probable first."""
        return np.argsort(-self.scores(vectors), axis=1, kind="stable")


def train(vectors: np.ndarray, parts: np.ndarray, edges: np.ndarray, count: int, seed: int = 12) -> Router:
    """Learn, for each vector, the shares of the parts among itself and its neighbours (cross-entropy, Adam)."""
    n, size = vectors.shape
    shares = np.zeros((n, count))
    np.add.at(shares, (np.arange(n), parts), 1.0)
    np.add.at(shares, (edges[:, 0], parts[edges[:, 1]]), 1.0)
    shares /= shares.sum(axis=1, keepdims=True)
    random = np.random.default_rng(seed)
    with np.errstate(over="ignore", invalid="ignore"):
        spread = np.nan_to_num(vectors.std(axis=0), posinf=_MOST)
        router = Router(
            np.nan_to_num(vectors.mean(axis=0)), np.where(spread > 0, spread, 1.0),
            random.standard_normal((size + 1, HIDDEN)) * np.sqrt(2 / (size + 1)), random.standard_normal((HIDDEN + 1, count)) * 0.1,
        )
    inputs, weights = router.inputs(vectors), [router.first, router.second]
    memory = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    step = 0
    for epoch in range(EPOCHS if count > 1 else 0):
        order = random.permutation(n)
        for at in range(0, n, 256):
            some, step = order[at : at + 256], step + 1
            hidden = np.hstack((np.maximum(inputs[some] @ weights[0], 0.0), np.ones((len(some), 1))))
            told = hidden @ weights[1]
            told = np.exp(told - told.max(axis=1, keepdims=True))
            wrong = (told / told.sum(axis=1, keepdims=True) - shares[some]) / len(some)
            back = (wrong @ weights[1][:-1].T) * (hidden[:, :-1] > 0)
            for w, slope, (m, v) in zip(weights, (inputs[some].T @ back, hidden.T @ wrong), memory, strict=True):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope**2 - v)
                w -= 0.004 * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return router


# --- the index -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """All rows (row, id, v, part) of vectors of one length, and how to search them."""

    rows: DataFrame
    size: int
    router: Router
    counts: dict[int, int]  # rows of each part
    probes: int
    recall: float  # as measured when it was built


def _sampled(rows: DataFrame, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct vectors to fit on, distinct vectors to measure with): rows drawn by a hash of their numbers."""
    fitting = min(SAMPLE, max(PART_ROWS, SAMPLE_BYTES // (8 * max(1, size))), n - n // 8)
    wanted = fitting + min(CHECKS, n - fitting)
    draw = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    drawn = rows.where(draw < int((1 << 30) * min(1.0, 2 * wanted / n + 1e-6))).orderBy(draw, "row").limit(wanted)
    table = drawn.select("id", "v").toArrow().combine_chunks()  # bounded by ``wanted``
    vectors = matrix(table.column(1).combine_chunks(), size, float) if len(table) else np.zeros((0, size))
    fit_on = np.unique(vectors[:fitting], axis=0)
    return fit_on, np.unique(vectors[fitting:], axis=0)


def _nearest(rows: DataFrame, queries: np.ndarray, k: int, size: int) -> pa.Table:
    """The k nearest rows (id, part) of some queries of a bounded number, at positive distances, by one scan."""
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(np.full(len(sent.value), -1), sent.value, k)
        for batch in batches:
            best.offer(np.arange(batch.num_rows), matrix(batch.column(0), size, float), batch.column(1).to_numpy())
        best.ids = np.arange(len(sent.value))
        yield best.told()

    order = Window.partitionBy("query_id").orderBy("score", "tag")
    told = rows.select("v", F.col("part").cast("long")).mapInArrow(run, NEAREST)
    found = told.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).toArrow()  # k a query
    sent.destroy()
    return found


def measured_probes(rows: DataFrame, checks: np.ndarray, router: Router, count: int, k: int, size: int, target: float) -> tuple[int, float]:
    """(the least number of parts that holds ``target`` of the k nearest rows of ``checks``, the share it holds)."""
    if not len(checks):
        return count, 1.0
    found = _nearest(rows, checks, k + 1, size)  # with its own row
    query, part, score = (found.column(c).to_numpy() for c in ("query_id", "tag", "score"))
    rank = np.argsort(router.ranked(checks), axis=1)[query, part][score > 0]
    if not len(rank):
        return count, 1.0
    held = np.cumsum(np.bincount(rank, minlength=count)) / len(rank)
    probes = min(count, int(np.searchsorted(held, target)) + 1)
    return probes, float(held[probes - 1])


def build(rows: DataFrame, size: int, k: int = 10, target: float = TARGET) -> Index:
    """An index over rows (row, id, v) of vectors that all have ``size`` components."""
    spark, n = rows.sparkSession, rows.count()
    fit_on, checks = _sampled(rows, n, size)
    levels = max(0, min(PARTS, len(fit_on) // PART_ROWS).bit_length() - 1)
    edges = neighbour_graph(spark, fit_on) if len(fit_on) > 1 else np.zeros((0, 2), np.int64)
    router = train(fit_on, balanced_parts(len(fit_on), edges, levels), edges, 1 << levels)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = router.scores(matrix(batch.column(2), size, float)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=["row", "id", "v", "part"])

    kind = rows.schema["v"].dataType.simpleString()
    placed = settle(rows.select("row", "id", "v").mapInArrow(place, f"row long, id long, v {kind}, part int"), "index")
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # one a part
    probes, recall = measured_probes(placed, checks, router, 1 << levels, k, size, target)
    return Index(placed, size, router, counts, probes, recall)


def _route(router: Router, probes: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = router.ranked(matrix(batch.column(2), size, float))[:, :probes]
            each = pa.array(np.repeat(np.arange(len(parts)), probes))
            yield pa.RecordBatch.from_arrays([*[c.take(each) for c in batch.columns], pa.array(parts.ravel().astype(np.int32))], names=["share", "id", "v", "part"])

    return run


def search_index(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, vec_id, score: at most k candidates a query and pair of shards, among them its k nearest in the parts searched."""
    size, kind = index.size, queries.schema["v"].dataType.simpleString()
    n, asked = sum(index.counts.values()), queries.count()
    widest = max(1, SHARD_BYTES // (8 * max(1, size)))
    row_shard = min(widest, max(LEAST_ROWS, -(-n // SHARDS)))
    query_shards = max(1, -(-asked // widest))
    shards = {p: -(-c // row_shard) for p, c in index.counts.items()}
    dealt = F.element_at(F.create_map(*[F.lit(x) for pair in shards.items() for x in pair]), F.col("part"))
    keys = ["part", "row_shard", "query_shard"]
    rows = index.rows.select("part", (F.col("row") % dealt).cast("int").alias("row_shard"), F.explode(F.sequence(F.lit(0), F.lit(query_shards - 1))).alias("query_shard"), "id", "v")
    share = F.pmod(F.xxhash64("id"), F.lit(query_shards)).cast("int").alias("share")
    routed = queries.select(share, "id", "v").mapInArrow(_route(index.router, index.probes, size), f"share int, id long, v {kind}, part int").where(F.col("part").isin(*shards))
    routed = routed.select("part", F.explode(F.sequence(F.lit(0), dealt - 1)).alias("row_shard"), F.col("share").alias("query_shard"), "id", "v")

    def meet(held: pa.Table, asking: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in FOUND.split(", ")]
        if not len(held) or not len(asking):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
        best = Nearest(asking.column("id").to_numpy(), matrix(asking.column("v").combine_chunks(), size, float), k)
        ids = held.column("id").to_numpy()
        for at in range(0, len(held), ROW_BLOCK):
            some = slice(at, at + ROW_BLOCK)
            best.offer(ids[some], matrix(held.column("v").slice(at, ROW_BLOCK).combine_chunks(), size, float), ids[some])
        return pa.Table.from_batches([best.told()]).select(names)

    return rows.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(meet, FOUND)


def usable(vectors: DataFrame, identifier: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(row, id, size, v) of the rows that take part."""
    known = vectors.where(F.col(identifier).isNotNull() & F.exists(column, lambda x: x != 0))
    return numbered(known, identifier, F.col(column), column, "neighbours")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, target: float = TARGET) -> DataFrame:
    """The k nearest of ``vectors`` found for each of ``queries`` (both as ``usable`` gives them, or a selection of its rows):
    query_id, rank, vec_id, score."""
    asked = settle(queries.groupBy("id").agg(F.min(F.struct("v", "size")).alias("q")).select("id", "q.v", "q.size"), "queries")
    found = None
    for size in lengths(asked):
        own = vectors.where(F.col("size") == size)
        if own.isEmpty():
            continue
        one = search_index(build(own, size, k, target), asked.where(F.col("size") == size).select("id", "v"), k)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return asked.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
