"""Mixing sources to target weights.

Sizes are summed per source, each source gets a share of all words by its weight, and every document is
then emitted floor(rate) times plus one more copy by a coin seeded with a hash of its identifier, whose
probability is the fraction of the rate.  The coin needs no state, so reruns and retried tasks agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a document
of size 0 is copied like any other; a source without words has target 0 and rate 0; an empty table gives
an empty mix; rows repeating a doc_id toss the same coin; a document without one tosses that of its text's digest;
texts are measured whole, however long; columns of the input may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvatica.llm.storage import settle, unused

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this number are broadcast to the documents (some MB at most); more are joined with salt.
BROADCAST_SOURCES = 50_000
SALTS = 64


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def coin(identifier: str, text: str | None = None, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 digest of the identifier, or of the text where it is null."""
    unnamed = F.concat(F.lit("null-"), F.md5(F.coalesce(F.col(text), F.lit("")))) if text else F.lit("null")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(identifier).cast("string"), unnamed))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def running(rows: DataFrame, by: Sequence[Column], columns: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``place`` (from 1, by ``by``) and, for each of ``columns``, the sum over all rows before as
    ``before_<column>``.  Ranges are sorted side by side and written; what lies before a range is a row per range."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = settle(rows.repartitionByRange(ranges, *by).withColumn("range", F.spark_partition_id()), "ranges")
    sums = {"place": F.count(F.lit(1)), **{c: F.sum(c) for c in columns}}
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    whole = held.groupBy("range").agg(*[f.alias(f"of_{c}") for c, f in sums.items()])
    offsets = whole.select("range", *[F.coalesce(F.sum(f"of_{c}").over(earlier), F.lit(0)).alias(f"of_{c}") for c in sums])
    inside = Window.partitionBy("range").orderBy(*by)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    within = held.withColumns({"place": F.row_number().over(inside), **{f"before_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in columns}})
    joined = within.join(F.broadcast(offsets), "range")
    moved = {"place": (F.col("place") + F.col("of_place")).cast("long"), **{f"before_{c}": F.col(f"before_{c}") + F.col(f"of_{c}") for c in columns}}
    return joined.withColumns(moved).select(*rows.columns, *moved)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> the same with ``weight``, ``target`` and ``rate``.

    Sources share the total by weight, none above ``cap`` times its size; what a capped source cannot take
    is shared again among the rest.  The fixed point has one level per unit of weight: with sources in order
    of cap * size / weight, those before the first whose bound lies above the level are capped.
    Sources are numbered and summed up in ranges, so there may be any number of them.
    """
    numbered = running(sizes.select("source", F.col("source_size").cast("long").alias("source_size")), [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    rows = numbered.select("source", "source_size", weight.cast("long").alias("weight"), F.col("place").alias("n"))
    rows = rows.withColumn("bound", F.col("source_size") * F.lit(float(cap)) / F.col("weight"))
    summed = settle(running(rows, [F.col("bound"), F.col("n")], ["source_size", "weight"]), "mix-levels")
    all_ = summed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double").alias("total"), F.sum("weight").alias("weights"))
    level = (F.col("total") - F.col("before_source_size") * F.lit(float(cap))) / (F.col("weights") - F.col("before_weight"))
    told = summed.crossJoin(F.broadcast(all_)).withColumn("level", level)  # one row
    # the level is right at the first source that it does not push over its bound
    first = told.where(F.col("level") <= F.col("bound")).agg(F.min(F.struct("bound", "n", "level")).alias("first")).select(F.col("first.level").alias("at"))
    met = summed.crossJoin(F.broadcast(first))  # one row
    target = F.when(F.col("at").isNull(), F.col("bound") * F.col("weight")).otherwise(F.least(F.col("at"), F.col("bound")) * F.col("weight")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    return met.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", F.col("weight").cast("int").alias("weight"), "target", "rate")


def with_copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: float = CAP, text: str = "text") -> DataFrame:
    """(doc_id, source, size) of every document with its source's figures and ``copies``, the number of
    times that the mix emits it.  The texts are scanned once; what is written is three columns wide."""
    measured = settle(docs.select("doc_id", "source", word_count(text).alias("size"), coin("doc_id", text).alias("coin")), "mix-sizes")
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = settle(source_targets(sizes, weights, cap), "mix-targets")
    return _attach(measured, targets, "copies", ["source_size", "weight", "target", "rate"], F.col("coin")).drop("coin")


def _attach(rows: DataFrame, targets: DataFrame, copies: str, keep: Sequence[str], toss: Column) -> DataFrame:
    """Rows with the column ``copies`` and the columns ``keep`` of their source; ``toss`` is each row's coin."""
    name, rate, salt = (unused(n, [*rows.columns, *keep, copies]) for n in ("source_name", "source_rate", "salt"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias(name)
    few = targets.count() <= BROADCAST_SOURCES
    rows, targets = rows.withColumn(name, key), targets.select(key, F.col("rate").alias(rate), *keep)
    if few:
        joined = rows.join(F.broadcast(targets), name)
    else:  # a hot source's rows go to SALTS tasks; the targets are a row per source, repeated SALTS times
        salted = targets.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn(salt, F.floor(toss * SALTS).cast("int")).join(salted, [name, salt]).drop(salt)
    whole = F.floor(F.col(rate))
    return joined.withColumn(copies, whole + (toss < F.col(rate) - whole).cast("long")).drop(name, rate)


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mix itself: every column of ``docs``, each document as many times as its source's rate asks.

    The texts are read again rather than shuffled: the first pass leaves a row per source, and the second
    needs nothing but that row and the document's own identifier.
    """
    sized = docs.select("source", word_count("text").alias("size"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = settle(source_targets(sizes, weights, cap), "mix-targets")
    copies, copy = (unused(n, docs.columns) for n in ("copies", "copy"))
    copied = _attach(docs, targets, copies, [], coin("doc_id", "text")).where(F.col(copies) > 0)
    emitted = copied.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return emitted.select(*docs.columns)
