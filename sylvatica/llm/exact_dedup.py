"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition turns its documents into a sorted run of (digest, best document, count), one row per
digest.  Partitions then exchange runs in binomial rounds: in a round, the runs of FAN_IN partitions whose
numbers differ in one digit meet, each partition taking the part of the digests that has its digit.  The
partition merges its runs in one sorted pass and keeps, per digest, the best row seen and the total count.
After log_FAN_IN(P) rounds partition i holds all digests that begin with i, merged over the whole corpus.

A digest that a third of all rows share is one row of each run from the first round on, so no round moves
or merges a hot group, and no task ever holds more than its share of the distinct digests.

Texts are equal when identical without the bytes [\\x20\\x09-\\x0D].  A row is keyed by the SHA-256 of that
text and verified by its length and a second, unrelated digest at every level.  Of equal texts the row with
the most code points in the original text stays, then the smallest doc_id.

Defined cases: a null text counts as empty, and all texts without visible characters are one group; rows
that repeat a doc_id with the same text are separate members and the first in the order of the written run
stays alone (``kept`` is true on one row of a group); a null doc_id sorts last; texts are read whole, however long;
an empty table gives no rows; other columns, whatever their names, are carried through by ``drop_duplicates`` and not
read by the rest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvatica.llm.storage import join_groups, keep_marked, settle, text_or_empty

FAN_IN = 16
_DROP = bytes((0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))

DIGESTS = "doc_id long, n_points int, raw long, digest binary, n_bytes long, check binary"
RUN = "digest binary, n_bytes long, check binary, n_points int, doc_id long, row long, members long, run int"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest, check, size = [], [], []
        for value in batch.column(3):
            plain = value.as_py().translate(None, _DROP)
            digest.append(hashlib.sha256(plain).digest())
            check.append(hashlib.blake2b(plain, digest_size=8).digest())
            size.append(len(plain))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(check, pa.binary())],
            names=["doc_id", "n_points", "raw", "digest", "n_bytes", "check"],
        )


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, code points, hash of the text as it is, digest, normalised bytes, second digest, row) of every document,
    written once."""
    source = docs.select(F.col("doc_id").cast("long"), F.char_length(text_or_empty(text)), F.xxhash64(text_or_empty(text)), text_or_empty(text).cast("binary"))
    return settle(source.mapInArrow(_digest, DIGESTS).withColumn("row", F.monotonically_increasing_id()), "digests")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse a partition sorted by (digest, n_bytes, check, best first) to a row per key."""
    held: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_arrays(batch.columns, names=batch.schema.names)  # all columns nullable, as those held are
        if held is not None:
            part = pa.concat_tables([held, part]).combine_chunks()
        n = part.num_rows
        if not n:
            continue
        new = np.ones(n, bool)
        if n > 1:
            same = np.ones(n - 1, bool)
            for name in ("run", "n_bytes"):
                value = part[name].to_numpy()
                same &= value[1:] == value[:-1]
            for name in ("digest", "check"):
                column = part[name].combine_chunks() if isinstance(part[name], pa.ChunkedArray) else part[name]
                equal = pa.compute.equal(column.slice(1), column.slice(0, n - 1))
                same &= equal.to_numpy(zero_copy_only=False)
            new[1:] = ~same
        first = np.flatnonzero(new)
        members = np.add.reduceat(part["members"].to_numpy(), first)
        merged = part.take(pa.array(first))
        merged = merged.set_column(merged.schema.get_field_index("members"), "members", pa.array(members, pa.int64()))
        held = merged.slice(merged.num_rows - 1)
        if merged.num_rows > 1:
            yield from merged.slice(0, merged.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _order() -> list:
    return [F.col("run"), F.col("digest"), F.col("n_bytes"), F.col("check"), F.col("n_points").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]



def merge_tree(rows: DataFrame, partitions: int) -> DataFrame:
    """One row per distinct text: the digest with its best document and the number of members.

    ``partitions`` is rounded up to a power of two.  Runs are numbered by the partition that holds them.
    """
    bits = max(1, math.ceil(math.log2(max(2, partitions))))
    step = int(math.log2(FAN_IN))
    # the first bits of the digest as a number: the run in which the digest ends up
    home = F.conv(F.substring(F.hex("digest"), 1, 6), 16, 10).cast("int").bitwiseAND((1 << bits) - 1)
    runs = rows.withColumn("members", F.lit(1).cast("long")).withColumn("run", F.spark_partition_id() % (1 << bits))
    order = [c.split()[0] for c in RUN.split(", ")]
    runs = runs.select(*order).sortWithinPartitions(*_order()).mapInArrow(_merge, RUN)
    low = 0
    while low < bits:
        mask = ((1 << min(step, bits - low)) - 1) << low
        # swap this digit of the run's number for the digest's own
        moved = runs.withColumn("run", F.col("run").bitwiseAND(~mask & ((1 << bits) - 1)).bitwiseOR(home.bitwiseAND(mask)))
        runs = moved.repartitionById(1 << bits, F.col("run")).sortWithinPartitions(*_order()).mapInArrow(_merge, RUN)
        low += step
    return runs


def mark_duplicates(docs: DataFrame, text: str = "text", partitions: int | None = None) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, digest (SHA-256 of the normalised text), raw (a
    hash of the text as it is)."""
    spark = docs.sparkSession
    rows = digests(docs, text)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = settle(
        merge_tree(rows, partitions).select("digest", "n_bytes", "check", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("members").alias("group_size")),
        "dedup-groups",
    )
    total = rows.count()
    marked = join_groups(rows, best, ["digest", "n_bytes", "check"], "group_size", total)
    return marked.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest", "raw")


def drop_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of equal texts, all its columns as they were.

    The row that stays is known by its doc_id and its text as it is; of whole repeated rows that agree in both one
    stays.  Texts of rows that have no copy are not moved.  Columns of the input may have any names.
    """
    marked = mark_duplicates(docs, text)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id")
    identities = marked.groupBy(name, "raw").agg(F.max("kept").alias("keep"), F.count(F.lit(1)).alias("n"))
    return keep_marked(docs, identities, text)
