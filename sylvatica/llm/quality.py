"""Importance resampling for quality: hashed n-gram models of target and raw text, and a Gumbel top-k draw.

A text's words and word pairs are hashed into BUCKETS.  Two bags of buckets are counted: the raw model over
every document, the target model over labelled good ones (TARGET_SAMPLE rows at most).  A document's log
importance weight is the sum over its n-grams of log p_target - log p_raw.  Adding independent Gumbel noise,
seeded by a hash of its doc_id, and keeping the k largest keys draws k documents without replacement with
probabilities proportional to the weights.

The counts are one array of BUCKETS longs per task, added up by bucket; the model is BUCKETS doubles.  The
k-th largest key is found by counting keys by their leading bits, 16 at a time, so nothing is sorted and no
task or driver holds more than 65,536 counts.

Defined cases: a null text counts as empty and has weight 0; without target rows all weights are 0 and the
draw is uniform; rows that repeat a doc_id have the same noise, and rows without one draw theirs by their texts;
keys equal at the k-th place are kept by
smallest doc_id (null last), and rows that agree in both stay together, so a few more than k may be kept; an
empty table gives no rows; texts are weighed whole, however long; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvatica.llm.storage import settle, text_or_empty
from sylvatica.llm.words import mix, slices, words

BUCKETS = 1 << 15
TARGET_SAMPLE = 20_000
SEED = 11
#: Kept where no labels tell how much of the corpus is good.
DEFAULT_SHARE = 0.5


def grams(buffer: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and every pair of neighbouring words."""
    found = words(buffer, offsets)
    text, h = found.text, found.hash
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.flatnonzero(text[1:] == text[:-1])
    value = np.concatenate((h, mix(h[pair] * np.uint64(3) + h[pair + 1])))
    return np.concatenate((text, text[pair])), (value % np.uint64(buckets)).astype(np.int64)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for first, last, buffer, offsets in slices(batch.column(1)):
                text, bucket = grams(buffer, offsets, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[good[first:last][text]], minlength=buckets)
        seen = np.flatnonzero(raw)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    return run


def log_ratio(docs: DataFrame, target_ids: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of each bucket.  ``target_ids``: one column doc_id, a bounded number of rows."""
    marks = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("good", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text")).join(F.broadcast(marks), "doc_id", "left")
    counted = rows.select(F.coalesce("good", F.lit(False)).alias("good"), "text").mapInArrow(_count(buckets), "bucket long, raw long, target long")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = sums["bucket"].to_numpy()
    raw[at], target[at] = sums["raw"].to_numpy(), sums["target"].to_numpy()
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def gumbel(identifier: str, seed: int = SEED) -> Column:
    """Gumbel noise from a hash of the identifier: -log(-log(u)), u in (0, 1)."""
    unit = (F.pmod(F.xxhash64(F.col(identifier), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(unit))


def weigh(docs: DataFrame, ratio: np.ndarray, text: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and key (log weight plus Gumbel noise) of every document."""
    buckets = len(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for first, last, buffer, offsets in slices(batch.column(1)):
                at, bucket = grams(buffer, offsets, buckets)
                parts.append(np.bincount(at, ratio[bucket], minlength=last - first))
            weight = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight, pa.float64()), batch.column(2)], names=["doc_id", "log_weight", "draw"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    drawn = rows.withColumn("draw", F.coalesce("doc_id", F.xxhash64("text")))  # documents without an id draw by their texts
    weighed = drawn.mapInArrow(run, "doc_id long, log_weight double, draw long")
    return weighed.withColumn("key", F.col("log_weight") + gumbel("draw", seed)).drop("draw")


def kth_largest(rows: DataFrame, column: str, k: int) -> tuple[int, int] | None:
    """(the k-th largest of a long column, how many rows lie above it); None if there are fewer rows than k."""
    known, above = 0, 0
    for level in range(4):
        shift = 48 - 16 * level
        part = rows if level == 0 else rows.where(F.shiftright(column, shift + 16) == known)
        counts = part.groupBy(F.shiftright(column, shift).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        for prefix, n in sorted(((r["p"], r["n"]) for r in counts), reverse=True):
            if above + n >= k:
                known = prefix
                break
            above += n
        else:
            return None
    return known, above


def _ordered(value: Column) -> Column:
    """A long in the order of a double: the double in millionths, within a long's range."""
    scaled = F.round(value * F.lit(2.0**20))  # keys differ by noise; a millionth tells them apart
    return F.greatest(F.least(scaled, F.lit(2.0**62)), F.lit(-(2.0**62))).cast("long")


def top_k(rows: DataFrame, k: int, key: str = "key") -> DataFrame:
    """The k rows with the largest keys; ties go to the smallest doc_id."""
    ranked = rows.withColumn("__o", _ordered(F.col(key)))
    if k <= 0:
        return rows.limit(0)
    found = kth_largest(ranked, "__o", k)
    if found is None:
        return rows
    bar, above = found
    level = ranked.where(F.col("__o") == bar).withColumn("__d", -F.coalesce(F.col("doc_id"), F.lit(2**62)))
    last = kth_largest(level, "__d", k - above)
    if last is None:
        return ranked.where(F.col("__o") >= bar).drop("__o")
    tie = (F.col("__o") == bar) & (-F.coalesce(F.col("doc_id"), F.lit(2**62)) >= last[0])
    return ranked.where((F.col("__o") > bar) | tie).drop("__o")


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", share: float | None = None, label: str = "quality", seed: int = SEED) -> DataFrame:
    """The drawn documents: doc_id, log_weight, key.

    k is ``share`` of all rows, by default the share of good rows among the labelled ones.  The target model
    is fitted on at most TARGET_SAMPLE good rows, the first by a hash of their id.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    good = known.where(F.col(label) > 0).select("doc_id", F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)).alias("o"))
    chosen = good.orderBy("o", "doc_id").limit(TARGET_SAMPLE).select("doc_id")
    scored = settle(weigh(docs, log_ratio(docs, chosen, text), text, seed), "importance")
    if share is None:
        share = known.agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]
        share = DEFAULT_SHARE if share is None else share
    return top_k(scored, round(share * scored.count()))
