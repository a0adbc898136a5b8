"""Exact set-similarity join on word shingles by a partition of the universe, and its components.

Two texts link when den * |intersection| >= num * |union| of their sets of shingles.

Size bands.  Sets are put into bands of sizes; a pair whose larger set lies in a band differs in at most
``delta`` shingles, and its smaller set is large enough to be indexed under that band as well.

Segments.  Under a band, shingles are hashed into segments.  A pair that differs in at most delta shingles
cannot differ by more than its allowance in every segment, if the allowances plus one add up to more than
delta: that is the pigeonhole.  A segment's allowance is 0 (the segments must be equal), 1 (equal, or one is
the other without one shingle: the one-deletion neighbourhood is indexed) or -1 (the segment is passed over).

Allocation.  Both choices go by cost.  For a band, the number of segments and of those that have an indexed
neighbourhood is the one with the least expected cost of signatures written and of nodes met by chance, given
how many sets have the band's sizes.  For a set, each unit of allowance costs what its signatures are expected
to meet by chance (COMMON to the power of the shingles in the segment, and for the second unit of a segment
that of each of its neighbours); the set takes the cheapest units that add up to more than delta.  All segments
are indexed; only those that a set allows for make candidates.

Candidates.  Equal sets are one node from the start.  A bucket (nodes that share a segment's signature) is
not expanded into pairs: its nodes are first compared with one of them, its hub, and links are joined into
components.  Then only nodes of different components are compared further, bucket by bucket in place, by sizes
and sketches; the pairs that are left must have met as often as the pigeonhole asks before their texts are read.
No pair that could join two components is left untested, so the components are those of all links.  A sketch is
a small histogram of a set's hashes; its bins grow with the set, and the difference of two bounds that of the
sets from below.

Keys.  A node is a 64-bit hash of a set; sets that share it by chance (told by a second hash) are given numbers
of their own before the index is made.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; a text
with fewer words than a shingle is one shingle; rows that repeat a doc_id are documents of their own that
share its number; a null doc_id is never the smallest; very long texts are sets like any other; an empty
table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvatica.llm.graph import components
from sylvatica.llm.storage import discard, join_groups, keep_marked, settle, text_or_empty, tidy
from sylvatica.llm.words import distinct, mix, shingles, slices, words

#: Sizes in a band differ by this factor at most.
BAND = 1.25
#: The chance that a shingle of a set is in another set of its band, and what a node met by chance costs against
#: a signature written: both only weigh costs.
COMMON = 0.02
CANDIDATE = 2.0
#: Bins of the sketch of a small set, and of the largest; and the shingles a bin has about.
BINS = 256
MOST_BINS = 1024
PER_BIN = 8
#: Buckets that a node shares with a hub at least to be compared with it before the last round.
HUB_SHARES = 2
#: Pairs that a task looks at, of which it holds sketches, and that it holds counted, at once.
PAIRS_AT_ONCE = 1 << 17
SKETCHES_AT_ONCE = 1 << 13
SUMS_AT_ONCE = 1 << 18
#: Nodes of a bucket that are compared with as many others in one group.
PART = 4096
#: A signature that this share of a task's texts at a time, and so many of them, have is hot: its rows are dealt to so many salts.
HOT_SHARE = 0.02
HOT_LEAST = 16
SALTS = 1024
#: Nodes that a task remembers to have seen.
SEEN = 1 << 18


@dataclass(frozen=True)
class Rule:
    """Shingles of ``size`` words; sets link at a Jaccard similarity of num / den or more."""

    size: int = 3
    num: int = 90
    den: int = 100
    #: Bits of a node's first hash: fewer than 64 make clashes, for tests.
    key_bits: int = 64

    def delta(self, largest: int) -> int:
        """The most shingles in which two linked sets of at most ``largest`` can differ."""
        return 2 * largest * (self.den - self.num) // (self.den + self.num)

    def smallest(self, size: int) -> int:
        """The size of the smallest set that can link with one of ``size``."""
        return -(-size * self.num // self.den)

    def linked(self, left, right, both):
        return self.den * both >= self.num * (left + right - both)


@dataclass(frozen=True)
class Band:
    """Pairs whose larger set has low..high shingles, whose units of allowance must add up to ``need``: the segments
    made, and how many of them, the first, have an indexed one-deletion neighbourhood."""

    low: int
    high: int
    smallest: int
    need: int
    segments: int
    deletions: int


def unit_costs(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the first and the second unit of allowance of segments of ``count`` shingles cost, relatively."""
    count = np.minimum(count, 64).astype(float)
    first = COMMON**count
    return first, np.maximum(first, count * COMMON ** np.maximum(count - 1, 0))


def allotment(need: int, size: int, nodes: int) -> tuple[int, int]:
    """(segments, neighbourhoods) of the least expected cost for sets of ``size`` among ``nodes`` others.

    Counts in segments are taken as Poisson; a set that has the band's need of units takes the cheapest ones.
    From a need of four on at least one segment has a neighbourhood."""
    count = np.arange(64)
    log_factorial = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 64)))))
    first, second = unit_costs(count)
    cost = np.concatenate((first, first, second))
    order = np.argsort(cost, kind="stable")
    best = (math.inf, need, 0)
    for deletions in sorted({1, 2, 4, 8, need // 4, need // 2} if need >= 4 else {0}):
        for factor in np.arange(1.0, 2.01, 0.05):
            segments = max(deletions + 1, math.ceil((need - deletions) * factor))
            if 2 * deletions > need or segments + deletions < need:
                continue
            mean = size / segments
            share = np.exp(count * math.log(mean) - mean - log_factorial)
            units = np.concatenate(((segments - deletions) * share, deletions * share, deletions * share))[order]
            taken = np.clip(need - (np.cumsum(units) - units), 0, units)
            met = nodes * math.exp(-mean) * float((taken * cost[order]).sum())
            best = min(best, (segments + deletions * mean + CANDIDATE * met, segments, deletions))
    return best[1], best[2]


def bands(rule: Rule, largest: int, nodes: dict[int, int] | None = None) -> list[Band]:
    """The bands up to ``largest``.  ``nodes`` has the number of sets by ``size_class``; any numbers give right results."""
    out, low = [], 1
    while low <= largest:
        high = max(low, math.ceil(low * BAND) - 1)
        delta = rule.delta(high)
        if delta:  # else only equal sets link
            smallest = min(low, rule.smallest(low))
            others = 1000 if nodes is None else sum(n for c, n in nodes.items() if size_class(smallest) <= c <= size_class(high))
            out.append(Band(low, high, smallest, delta + 1, *allotment(delta + 1, low, max(1, others))))
        low = high + 1
    return out


def size_class(size: int) -> int:
    """Sizes by their bits and the next two binary digits."""
    bits = size.bit_length() - 1
    return 4 * bits + ((4 * size >> bits) & 3)


def set_key(text: np.ndarray, value: np.ndarray, n: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's set of shingles, the first cut to ``bits``."""
    high, low = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(high, text, mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    np.add.at(low, text, mix(value + np.uint64(0x0123456789ABCDEF)))
    return mix(high) >> np.uint64(64 - bits), mix(low)


def bins_for(size: np.ndarray) -> np.ndarray:
    """Bins of the sketches of sets of ``size``: a power of two, about a bin for PER_BIN shingles."""
    want = np.maximum(1, -(-size // PER_BIN)).astype(float)
    return np.clip(2 ** np.ceil(np.log2(want)).astype(np.int64), BINS, MOST_BINS)


def sketches(text: np.ndarray, value: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A histogram of each set's hashes, counts up to 15 and two to a byte; capped counts of the same bins differ no more
    than the counts, and those of a sketch folded to fewer bins are capped again."""
    bins = bins_for(size)
    base = np.concatenate(([0], np.cumsum(bins)))
    place = (mix(value ^ np.uint64(0x77)) >> np.uint64(40)).astype(np.int64) & (bins[text] - 1)
    counts = np.minimum(np.bincount(base[text] + place, minlength=base[-1]), 15).astype(np.uint8)
    packed = counts[0::2] | (counts[1::2] << 4)
    return [packed[base[i] // 2 : base[i + 1] // 2].tobytes() for i in range(len(size))]


class Sketches:
    """Sketches of rows, compared at the fewer bins of a pair."""

    def __init__(self, packed: list[bytes]) -> None:
        self.bins = np.fromiter((2 * len(p) for p in packed), np.int64, len(packed))
        self.at: dict[int, np.ndarray] = {}
        self.row: dict[int, np.ndarray] = {}
        for bins in np.unique(self.bins).tolist():
            chosen = np.flatnonzero(self.bins >= bins)
            out = np.empty((len(chosen), bins), np.int8)
            for full in np.unique(self.bins[chosen]).tolist():
                mine = self.bins[chosen] == full
                half = np.frombuffer(b"".join(packed[i] for i in chosen[mine].tolist()), np.uint8).reshape(-1, full // 2)
                whole = np.empty((len(half), full), np.int8)
                whole[:, 0::2], whole[:, 1::2] = half & 15, half >> 4
                # capped again: so a folded sketch is what the set's sketch of fewer bins would be
                out[mine] = np.minimum(whole.reshape(len(half), full // bins, bins).sum(axis=1, dtype=np.int8), 15)
            self.at[bins] = out
            self.row[bins] = np.full(len(packed), -1)
            self.row[bins][chosen] = np.arange(len(chosen))

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A lower bound of the symmetric difference of each pair of rows."""
        out = np.zeros(len(i), np.int64)
        fewer = np.minimum(self.bins[i], self.bins[j])
        for bins, table in self.at.items():
            mine = np.flatnonzero(fewer == bins)
            x, y = self.row[bins][i[mine]], self.row[bins][j[mine]]
            step = max(1, SKETCHES_AT_ONCE * BINS // bins)
            for k in range(0, len(mine), step):
                out[mine[k : k + step]] = np.abs(table[x[k : k + step]] - table[y[k : k + step]]).sum(axis=1, dtype=np.int64)
        return out


def signatures(text: np.ndarray, value: np.ndarray, size: np.ndarray, plan: list[Band]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, signature, whether it makes candidates) of every set, from its sorted distinct shingles.

    A segment's signature is a hash of the sum of its shingles' hashes, so that of the segment without one
    shingle is a subtraction away.
    """
    if not plan:  # all sets are so small that only equal ones link
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    lows, least, highs = (np.array([getattr(b, k) for b in plan]) for k in ("low", "smallest", "high"))
    segments, deletions, needs = (np.array([getattr(b, k) for b in plan]) for k in ("segments", "deletions", "need"))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    own = np.searchsorted(lows, size, side="right") - 1  # the last band that begins at or below the size
    for step in range(len(plan) + 1):
        band = own + step
        inside = (band >= 0) & (band < len(plan)) & (size > 0)
        at = np.clip(band, 0, len(plan) - 1)
        # its own band, if that has one, and the bands above under which it can be the smaller set
        inside &= (size <= highs[at]) if step == 0 else (size >= least[at])
        if step and not inside.any():
            break
        chosen = np.flatnonzero(inside)
        if not len(chosen):
            continue
        number = np.full(len(size), -1)
        number[chosen] = np.arange(len(chosen))
        mine = number[text] >= 0
        who, x = number[text[mine]], mix(value[mine] + np.uint64(0x1F))
        b = at[chosen]
        m = segments[b]
        base = np.concatenate(([0], np.cumsum(m)))
        local = ((mix(x ^ np.uint64(0x3C3C)) >> np.uint64(33)) % m[who].astype(np.uint64)).astype(np.int64)
        cell = base[who] + local
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, cell, x)
        count = np.bincount(cell, minlength=base[-1])
        owner = np.repeat(np.arange(len(chosen)), m)
        place = np.arange(base[-1]) - base[owner]
        tag = mix((b[owner].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1))
        whole = mix(total + tag * np.uint64(5) + count.astype(np.uint64))
        # units of allowance, one of each segment and a second of those with a neighbourhood, the cheapest first
        twice = np.flatnonzero(place < deletions[b][owner])
        unit = np.concatenate((np.arange(base[-1]), twice))
        first, second = unit_costs(count)
        later = np.arange(len(unit)) >= base[-1]
        order = np.lexsort((later, place[unit], np.concatenate((first, second[twice])), owner[unit]))
        before = np.concatenate(([0], np.cumsum(m + deletions[b])))[owner[unit[order]]]
        spent = order[np.arange(len(order)) - before < needs[b][owner[unit[order]]]]
        units = np.bincount(unit[spent], minlength=base[-1])
        out.append((chosen[owner], whole, units > 0))
        gone = np.flatnonzero(local < deletions[b][who])
        if len(gone):
            c = cell[gone]
            out.append((chosen[who[gone]], mix(total[c] - x[gone] + tag[c] * np.uint64(5) + (count[c] - 1).astype(np.uint64)), units[c] > 1))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


SETS = "doc_id long, digest long, node long, low long, n_shingles long, sketch binary"
INDEX = "signature long, salt int, node long, probe boolean"


def _sets_of(column: pa.Array, rule: Rule) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, text, shingle, sizes) of an Arrow column in runs of bounded size."""
    for first, last, buffer, offsets in slices(column):
        text, value = distinct(*shingles(words(buffer, offsets), rule.size))
        yield first, last, text, value, np.bincount(text, minlength=last - first)


def _sets(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, text, value, size in _sets_of(batch.column(2), rule):
                high, low = set_key(text, value, last - first, rule.key_bits)
                empty = size == 0
                columns = [*(batch.column(i).slice(first, last - first) for i in (0, 1)), pa.array(high.view(np.int64), mask=empty), pa.array(low.view(np.int64), mask=empty), pa.array(size, pa.int64())]
                columns.append(pa.array(sketches(text, value, size), pa.binary(), mask=empty))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "node", "low", "n_shingles", "sketch"])

    return run


Renamed = dict[tuple[int, int], int]


def _nodes(rule: Rule, renamed: Renamed, text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The node of each set: its first hash, or the number of its own if it shares that with another set."""
    high, low = set_key(text, value, n, rule.key_bits)
    node = high.view(np.int64).copy()
    if renamed:
        for i in np.flatnonzero(np.isin(node, np.array([high for high, _ in renamed]))).tolist():
            node[i] = renamed.get((int(node[i]), int(low.view(np.int64)[i])), int(node[i]))
    return node


def _unseen(node: np.ndarray, asked: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows of ``asked`` are the first of their node that the task sees (or remembers)."""
    new = np.zeros(len(node), bool)
    if len(seen) > SEEN:
        seen.clear()
    for i in np.flatnonzero(asked).tolist():
        key = int(node[i])
        if key not in seen:
            seen.add(key)
            new[i] = True
    return new


def _index(rule: Rule, plan: list[Band], renamed: Renamed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal texts of a task are indexed once
        for batch in batches:
            for first, last, text, value, size in _sets_of(batch.column(0), rule):
                node = _nodes(rule, renamed, text, value, last - first)
                new = _unseen(node, size > 0, seen)
                mine = new[text]
                who, signature, probe = signatures(text[mine], value[mine], np.where(new, size, 0), plan)
                if len(who):
                    rows = salted(signature.view(np.int64), node[who], probe, int(new.sum()))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=[c.split()[0] for c in INDEX.split(", ")])

    return run


def salted(signature: np.ndarray, node: np.ndarray, probe: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, salt, node, probe): the rows of hot signatures with salts of their nodes, and of each hot signature a row
    that stands for them without a salt, one that makes candidates if any does."""
    order = np.lexsort((~probe, signature))
    ordered = signature[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    count = np.diff(np.append(first, len(ordered)))
    hot = count >= max(HOT_LEAST, HOT_SHARE * texts)
    salt = np.zeros(len(signature), np.int32)
    salt[order] = np.where(np.repeat(hot, count), 1 + (mix(node[order].view(np.uint64)) % np.uint64(SALTS)).astype(np.int32), 0)
    standing = order[first[hot]]
    return tuple(np.concatenate((column, column[standing])) if column is not salt else np.concatenate((salt, np.zeros(len(standing), np.int32))) for column in (signature, salt, node, probe))


def _buckets(docs: DataFrame, rule: Rule, plan: list[Band], renamed: Renamed, text: str) -> DataFrame:
    """(signature, node, probe, n: the bucket's rows, or those of its salt) of the buckets that hold two nodes or more and make
    candidates; rows with a salt all go on.

    The window streams over a sorted partition and spills what it holds of a bucket.  A hot bucket is spread by salts before,
    so no task meets it whole; what stands for its rows lets the rows without a salt find that they are not alone."""
    rows = docs.select(text_or_empty(text).alias("text")).mapInArrow(_index(rule, plan, renamed), INDEX)
    same = Window.partitionBy("signature", "salt")
    marked = rows.select("*", F.min("node").over(same).alias("first"), F.max("node").over(same).alias("last"), F.max("probe").over(same).alias("live"), F.count(F.lit(1)).over(same).alias("n"))
    return settle(marked.where(((F.col("first") != F.col("last")) & F.col("live")) | (F.col("salt") > 0)).select("signature", "node", "probe", "n"), "buckets")


def _close(rule: Rule):
    """Pairs whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_a, n_b = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            both = Sketches([v.as_py() for i in (4, 5) for v in batch.column(i)])
            least = both.differ(np.arange(n), n + np.arange(n))  # of the symmetric difference
            keep = pa.array(rule.linked(n_a, n_b, np.minimum((n_a + n_b - least) // 2, np.minimum(n_a, n_b))))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _exact(rule: Rule):
    """Pairs whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = batch.column(3)
            for first, last, text_a, value_a, n_a in _sets_of(batch.column(2), rule):
                both = np.zeros(last - first, np.int64)
                n_b = np.zeros(last - first, np.int64)
                for start, stop, text_b, value_b, sizes in _sets_of(right.slice(first, last - first), rule):
                    n_b[start:stop] = sizes
                    mine = (text_a >= start) & (text_a < stop)
                    text = np.concatenate((text_a[mine], text_b + start))
                    value = np.concatenate((value_a[mine], value_b))
                    order = np.lexsort((value, text))
                    text, value = text[order], value[order]
                    twice = np.flatnonzero((text[1:] == text[:-1]) & (value[1:] == value[:-1]))
                    both += np.bincount(text[twice], minlength=last - first)
                keep = pa.array(rule.linked(n_a, n_b, both))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(first, last - first).filter(keep) for i in (0, 1)], names=["a", "b"])

    return run


def _texts(docs: DataFrame, wanted: DataFrame, rule: Rule, renamed: Renamed, text: str) -> DataFrame:
    """(node, text): a text of each node of ``wanted`` (node, least and digest: those of a row that has it).

    A row counts only if its text has the node's set, whatever other rows share its id and digest.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat an id and a text meet in one task
        for batch in batches:
            asked = batch.column(0).to_numpy()
            for first, last, at, value, size in _sets_of(batch.column(1), rule):
                node = _nodes(rule, renamed, at, value, last - first)
                keep = pa.array(_unseen(node, (node == asked[first:last]) & (size > 0), seen))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(first, last - first).filter(keep) for i in (0, 1)], names=["node", "text"])

    # a condition that holds always lets Spark take the wanted rows for a selection and sift the texts by a Bloom filter
    # before it shuffles them
    keys = wanted.where(F.col("node") >= F.lit(-(2**63))).select("node", _number("least").alias("id"), "digest")
    rows = docs.select(_number("doc_id").alias("id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    return settle(rows.join(keys, ["id", "digest"]).select("node", "text").mapInArrow(check, "node long, text string"), "node-texts", sift=True)


def _number(column: str) -> Column:
    """An id as text, so that null is one of them."""
    return F.coalesce(F.col(column).cast("long").cast("string"), F.lit("null"))


@dataclass
class Corpus:
    """What the steps of a join read: the documents, and (node, least, digest, n_shingles, sketch) of every node."""

    docs: DataFrame
    nodes: DataFrame
    rule: Rule
    plan: list[Band]
    renamed: Renamed
    text: str


def _verified(pairs: DataFrame, corpus: Corpus) -> DataFrame:
    """The pairs that link.  Only the texts of pairs whose sketches allow it are fetched.  What a member has is joined
    to its pair first and what its hub ``a`` has last, so that no hub's text is written once a pair; Spark splits
    the partition of a hot hub."""
    rule = corpus.rule
    side = lambda k: corpus.nodes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"h_{k}"))
    described = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "h_a", "h_b")
    close = settle(described.mapInArrow(_close(rule), "a long, b long"), "close")
    ends = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
    wanted = settle(corpus.nodes.select("node", "least", "digest").join(ends, "node", "left_semi"), "wanted")
    texts = _texts(corpus.docs, wanted, rule, corpus.renamed, corpus.text)
    body = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"t_{k}"))
    whole = close.join(body("b"), "b").join(body("a"), "a").select("a", "b", "t_a", "t_b")
    links = settle(whole.mapInArrow(_exact(rule), "a long, b long"), "links")
    for table in (close, wanted, texts):
        discard(table)
    return links


def _compare(rule: Rule, plan: list[Band]):
    """(a, b, shared, required): in how many buckets of the task a pair meets, and in how many at least if it links.

    Under the band of its larger set, a set allows for nothing or one shingle in at least need - deletions segments.
    A pair that differs in d shingles agrees in all but d of them, so it meets in that number less d.

    All pairs of different components, one of them making candidates, within each group of rows sorted by
    (signature, left, right), of which those go on that a link is possible for by size and sketch.  Pairs are
    compared in place, PAIRS_AT_ONCE at a time whatever the groups' sizes, and the counted ones are told as soon
    as there are SUMS_AT_ONCE."""

    lows = np.array([b.low for b in plan])
    agree = np.array([b.need - b.deletions for b in plan])

    def starts(rows: pa.Table) -> np.ndarray:
        new = np.ones(rows.num_rows, bool)
        new[1:] = False
        for name in ("signature", "left", "right"):
            value = rows[name].to_numpy()
            new[1:] |= value[1:] != value[:-1]
        return np.flatnonzero(new)

    def summed(a: np.ndarray, b: np.ndarray, shared: np.ndarray, required: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((b, a))
        a, b, shared, required = a[order], b[order], shared[order], required[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        return [a[first], b[first], np.add.reduceat(shared, first) if len(first) else shared, required[first]]

    def partners(home: np.ndarray, probe: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first, last + 1) of the rows that a row is compared with: those of other components after it, which are
        the other components' that make candidates and the other components' that make none.  Rows are sorted by group
        (``stop`` is its end), those that make candidates first, then by component."""
        n = len(home)
        new = np.ones(n, bool)
        new[1:] = stop[1:] != stop[:-1]
        group = np.cumsum(new) - 1
        at = np.flatnonzero(probe)
        middle = (np.flatnonzero(new) + np.bincount(group[at], minlength=int(new.sum())))[group]  # where a group's rows that make none begin
        _, code = np.unique(home, return_inverse=True)
        key = group * (int(code.max(initial=0)) + 1) + code

        def run(chosen: np.ndarray, side: str) -> np.ndarray:
            return np.searchsorted(key[chosen], key[at], side=side)

        rest = np.flatnonzero(~probe)
        own_end = np.append(at, n)[run(at, "right") - 1] + 1  # the end of its own component among those that make candidates
        low, high = run(rest, "left"), run(rest, "right")
        some = high > low
        begin = np.where(some, np.append(rest, n)[np.minimum(low, len(rest))], stop[at])
        end = np.where(some, begin + (high - low), stop[at])
        of, first, last = np.concatenate((at, at, at)), np.concatenate((own_end, middle[at], end)), np.concatenate((middle[at], begin, stop[at]))
        keep = last > first
        return of[keep], first[keep], last[keep]

    def found(rows: pa.Table, stop: np.ndarray) -> Iterator[list[np.ndarray]]:
        """The counted pairs of whole groups; ``stop``: for each row the end of its group."""
        node, home, size, probe, part, left, right = (rows[c].to_numpy() for c in ("node", "component", "n_shingles", "probe", "part", "left", "right"))
        order = np.lexsort((home, ~probe, stop))  # in each group those that make candidates first, by component
        node, home, size, probe, part, across = node[order], home[order], size[order], probe[order], part[order], (left != right)[order]
        packed = rows["sketch"].to_pylist()
        bins = Sketches([packed[i] for i in order.tolist()])
        of, first, last = partners(home, probe, stop)
        sums = np.concatenate(([0], np.cumsum(last - first)))
        row = 0
        while row < len(of):
            end = max(row + 1, int(np.searchsorted(sums, sums[row] + PAIRS_AT_ONCE, side="right")) - 1)
            size_of = last[row:end] - first[row:end]
            i = np.repeat(of[row:end], size_of)
            j = np.arange(len(i)) + np.repeat(first[row:end] - (sums[row:end] - sums[row]), size_of)
            row = end
            least = np.minimum(size[i], size[j])
            fits = np.flatnonzero((~across[i] | (part[i] != part[j])) & rule.linked(size[i], size[j], least))
            i, j, least = i[fits], j[fits], least[fits]
            both = np.minimum((size[i] + size[j] - bins.differ(i, j)) // 2, least)
            keep = np.flatnonzero(rule.linked(size[i], size[j], both))
            if len(keep):
                i, j = i[keep], j[keep]
                total = size[i] + size[j]
                band = np.searchsorted(lows, np.maximum(size[i], size[j]), side="right") - 1
                required = np.where(band >= 0, np.maximum(1, agree[band] - total * (rule.den - rule.num) // (rule.den + rule.num)), 1)
                yield summed(np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), np.ones(len(i), np.int64), required)

    def told(sums: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in sums], names=["a", "b", "shared", "required"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        sums = [np.zeros(0, np.int64)] * 4

        def count(rows: pa.Table, stop: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal sums
            for new in found(rows, stop):
                sums = summed(*[np.concatenate(pair) for pair in zip(sums, new, strict=True)])
                if len(sums[0]) > SUMS_AT_ONCE:
                    yield told(sums)
                    sums = [np.zeros(0, np.int64)] * 4

        for batch in batches:
            part = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
            held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
            edge = starts(held)
            if len(edge) > 1:  # the last group may go on in the next batch
                yield from count(held.slice(0, edge[-1]), np.repeat(edge[1:], np.diff(edge)))
                held = held.slice(edge[-1])
        if held is not None and held.num_rows:
            yield from count(held, np.full(held.num_rows, held.num_rows))
        yield told(sums)

    return run


def _parted(open_: DataFrame) -> DataFrame:
    """``open_`` with ``part``, ``left`` and ``right``: rows of one (signature, left, right) are compared with each other.

    A bucket of more than PART rows is cut into parts, those of its home component apart from the others.  Parts of
    the others meet every part and those of the home component only the others', so a large component is repeated
    as often as there are parts outside it, and no group holds more than some two parts."""
    none = {"part": F.lit(0), "left": F.lit(0), "right": F.lit(0)}
    few = open_.where(F.col("n") <= PART).withColumns(none).drop("n", "home")
    many = open_.where(F.col("n") > PART)
    outside = F.col("component") != F.col("home")
    split = many.groupBy("signature").agg(F.count_if(outside).alias("outer"), F.count(F.lit(1)).alias("rows"))
    cut = join_groups(many, split, ["signature"], "rows", open_.count())
    outer, inner = F.greatest(F.lit(1), F.ceil(F.col("outer") / PART)).cast("int"), F.ceil((F.col("rows") - F.col("outer")) / PART).cast("int")
    hashed = F.xxhash64("node")
    cut = cut.withColumns({
        "part": F.when(outside, F.pmod(hashed, outer)).otherwise(outer + F.pmod(hashed, inner)).cast("int"),
        "other": F.explode(F.when(outside, F.sequence(F.lit(0), outer + inner - 1)).otherwise(F.sequence(F.lit(0), outer - 1))),
    })
    cut = cut.withColumns({"left": F.least("part", "other"), "right": F.greatest("part", "other")}).drop("n", "home", "outer", "rows", "other")
    return few.unionByName(cut)


def _open_pairs(open_: DataFrame, corpus: Corpus) -> DataFrame:
    """The pairs of open buckets that might link, by sizes, sketches and the buckets they share."""
    described = open_.join(corpus.nodes.select("node", "n_shingles", "sketch"), "node")
    sorted_ = described.repartition(F.col("signature"), F.col("left"), F.col("right")).sortWithinPartitions("signature", "left", "right")
    names = ["signature", "node", "probe", "component", "n_shingles", "sketch", "part", "left", "right"]
    met = sorted_.select(*names).mapInArrow(_compare(corpus.rule, corpus.plan), "a long, b long, shared long, required long")
    often = met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("required").alias("required"))
    return often.where("shared >= required").select("a", "b")


def _open(members: DataFrame, total: int) -> DataFrame:
    """The rows of buckets that hold two components and make candidates, with the bucket's rows ``n``, its ``hub``
    and the component of its weightiest node, ``home``.  A bucket's figures are partial sums of tasks first."""
    order = F.struct((-F.col("weight")).alias("o"), F.col("node").alias("node"), F.col("component").alias("component"))
    figures = members.groupBy("signature").agg(
        F.min("component").alias("first"), F.max("component").alias("last"), F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("probe"), order)).alias("hub"), F.min(order).alias("home"),
    )
    several = figures.where((F.col("first") != F.col("last")) & F.col("hub").isNotNull()).select("signature", "n", F.col("hub.node").alias("hub"), F.col("hub.component").alias("hub_home"), F.col("home.component").alias("home"))
    return settle(join_groups(members, several, ["signature"], "n", total).select("signature", "node", "probe", "component", "n", "hub", "hub_home", "home"), "open")


def _links(buckets: DataFrame, corpus: Corpus) -> DataFrame:
    """(node, component) of the nodes that link with another."""
    spark = buckets.sparkSession
    # a node with many neighbours is likely the text that the others were made from: a good hub
    weights = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    members = settle(buckets.drop("n").join(weights, "node"), "members")
    discard(buckets)
    total = members.count()
    found = spark.createDataFrame([], "node long, component long")
    open_ = _open(members.withColumn("component", F.col("node")), total)
    apart = open_.where(F.col("node") != F.col("hub")).groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    # a hub that meets a node in one bucket only is there by chance; the last round passes over nothing
    tested = settle(apart.where(F.col("shared") >= HUB_SHARES).select("a", "b"), "pairs")
    discard(open_)
    tidy(spark)
    links = _verified(tested, corpus)
    tidy(spark)
    if not links.isEmpty():
        found = components(links)
    open_ = _open(members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), total)
    discard(members)
    if not open_.isEmpty():
        known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = settle(_open_pairs(_parted(open_.drop("hub", "hub_home")), corpus).join(known, ["a", "b"], "left_anti"), "pairs")
        tidy(spark)
        more = _verified(pairs, corpus)
        tidy(spark)
        if not more.isEmpty():
            found = components(links.unionByName(more))
        discard(pairs)
        discard(more)
    for table in (open_, tested, links):
        discard(table)
    return found


def _renamed(classes: DataFrame) -> Renamed:
    """Numbers of their own for the sets that share a node with another: a few at most, as a pair of sets does so
    with a probability of 2 ** -64 (some three among 10 ** 10 sets)."""
    clash = classes.groupBy("node").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("node")
    sets = settle(classes.join(clash, "node", "left_semi").select("node", "low"), "clashes")
    for turn in range(8):
        named = sets.withColumn("own", F.xxhash64("node", "low", F.lit(turn)))
        twice = named.groupBy("own").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
        if twice.isEmpty() and named.join(classes.select(F.col("node").alias("own")), "own", "left_semi").isEmpty():
            return {(r["node"], r["low"]): r["own"] for r in named.collect()}
    raise RuntimeError("no free numbers for sets that share a key")  # once in 2 ** 500 or so


def _grouped(docs: DataFrame, rule: Rule, text: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of SETS, and (doc_id, digest, n_shingles, component, component_id) of those with words, if any have.

    ``digest`` is that of the text, and tells apart the rows that share a doc_id; ``component`` is the component
    itself, which has no component_id where all its ids are null.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias(text))
    rows = settle(source.select("doc_id", F.xxhash64(text).alias("digest"), text).mapInArrow(_sets(rule), SETS), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc_id"), F.col("digest").alias("digest"), "n_shingles", "sketch"))
    grouped = rows.where("n_shingles > 0").groupBy("node", "low").agg(first.alias("first"), F.count(F.lit(1)).alias("members"))
    classes = settle(grouped.select("node", "low", F.col("first.doc_id").alias("least"), F.col("first.digest").alias("digest"), "first.n_shingles", "first.sketch", "members"), "classes")
    bits = F.length(F.bin("n_shingles")) - 1
    kind = 4 * bits + F.floor(F.col("n_shingles") * 4 / F.pow(F.lit(2.0), bits)).cast("int").bitwiseAND(3)
    sizes = classes.groupBy(kind.cast("int").alias("kind")).agg(F.max("n_shingles").alias("largest"), F.count(F.lit(1)).alias("n")).collect()  # some 100 at most
    if not sizes:
        return rows, None
    renamed = _renamed(classes)
    own = F.col("node")
    if renamed:
        own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for (high, low), new in renamed.items() for x in (f"{high} {low}", new)]), F.concat_ws(" ", "node", "low")), "node")
    plan = bands(rule, max(r["largest"] for r in sizes), {r["kind"]: r["n"] for r in sizes})
    buckets = _buckets(source, rule, plan, renamed, text)
    tidy(spark)
    numbered = classes.withColumn("own", own)
    corpus = Corpus(source, numbered.select(F.col("own").alias("node"), "least", "digest", "n_shingles", "sketch"), rule, plan, renamed, text)
    found = _links(buckets, corpus)
    named = numbered.join(found.withColumnRenamed("node", "own"), "own", "left").withColumn("component", F.coalesce("component", "own"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("members").alias("size"))
    total = rows.count()
    homes = settle(join_groups(named.select("node", "low", "members", "component"), smallest, ["component"], "size", total).select("node", "low", "members", "component", "component_id"), "homes")
    linked = join_groups(rows.where("n_shingles > 0").select("doc_id", "digest", "node", "low", "n_shingles"), homes, ["node", "low"], "members", total)
    discard(classes)
    return rows, linked.select("doc_id", "digest", "n_shingles", "component", "component_id")


def similar_groups(docs: DataFrame, rule: Rule | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every document."""
    rows, linked = _grouped(docs, rule or Rule(), text)
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return empty if linked is None else linked.select("doc_id", "n_shingles", "component_id").unionByName(empty)


def keep_one(docs: DataFrame, rule: Rule | None = None, text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, one of those with its smallest doc_id, and all rows without words.

    A row is known by its doc_id and its text's digest; of rows that share both, and so are copies, one stays.
    Texts of rows that surely stay are not moved.  Columns of the input may have any names.
    """
    _, linked = _grouped(docs, rule or Rule(), text)
    if linked is None:
        return docs
    named = settle(linked.select(_number("doc_id").alias("id"), F.col("digest").alias("raw"), "component", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first"), "doc_id"), "named")
    least = named.where("first").groupBy("component").agg(F.min("doc_id").alias("doc_id"), F.min("raw").alias("raw"))
    keep = least.select(_number("doc_id").alias("id"), "raw", F.lit(True).alias("keep"))
    counts = named.groupBy("id", "raw").agg(F.count(F.lit(1)).alias("n"))
    identities = counts.join(keep, ["id", "raw"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
    return keep_marked(docs, identities, text)
