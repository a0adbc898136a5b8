"""Intermediate tables in the folder that the cluster shares, and joins that a hot key cannot slow."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least this share of all rows is heavy; so at most ``1 / HEAVY_SHARE`` keys are.
HEAVY_SHARE = 1 / 5_000
#: A key with fewer rows than this is never heavy, however small the table.
HEAVY_LEAST = 200
#: Bits that Spark keeps in one bitmap, and bits that a sieve has for each identity, and as a power of two at most (16 MB).
BITMAP = 32_768
BITS_EACH = 16
MOST_BITS = 27


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  A local session without one gets a folder of its own; on a cluster, whose
    machines do not share their disks, that would lose rows, so it raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='sylvatica-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/sylvatica/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


#: While a table is settled: bytes that Spark hands to a Python worker at once.
SETTLING = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: And where it is to sift a large table before a shuffle: a Bloom filter of the other side's keys, on whatever table and
#: however many keys (its size is bounded: a megabyte, meant for a million keys; more only let more rows through).
SIFTING = {
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g",
}


def settle(df: DataFrame, label: str, sift: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs survive the loss of any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    wanted = SETTLING | (SIFTING if sift else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, of whose session Arrow batches are bounded in bytes from now on, unless they are already: a result with
    whole texts is written by a caller, and by default a worker gets 10,000 texts or 64 MB at once."""
    key, value = next(iter(SETTLING.items()))
    if rows.sparkSession.conf.get(key, None) is None:
        rows.sparkSession.conf.set(key, value)
    return rows


def tidy(spark: SparkSession) -> None:
    """Let the files of shuffles that no plan refers to any more go now rather than at some later collection.

    Spark deletes them once the driver's JVM has collected the objects that stand for them, which an idle
    driver does rarely; a job of many steps would keep every step's shuffle on disk to its end.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)  # the last query's end is told to listeners by another thread, which holds its plan till then
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a settled table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/sylvatica/{spark.sparkContext.applicationId}/" not in folder:
            raise ValueError(f"{folder} was not written by settle()")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their one row in ``groups`` (inner join on ``keys``).

    ``size`` names the column of ``groups`` that counts a group's rows and ``total`` all rows.  Groups
    that hold more than HEAVY_SHARE of the rows number 1 / HEAVY_SHARE at most, so that side is broadcast
    whatever the data; all other groups are joined by a shuffle in which no key is large.
    """
    least = max(HEAVY_LEAST, int(total * HEAVY_SHARE))
    heavy, light = groups.where(F.col(size) >= least), groups.where(F.col(size) < least)
    marks = heavy.select(*keys).withColumn("__heavy", F.lit(True))
    marked = rows.join(F.broadcast(marks), keys, "left")
    hot = marked.where(F.col("__heavy").isNotNull()).drop("__heavy").join(F.broadcast(heavy), keys)
    cold = marked.where(F.col("__heavy").isNull()).drop("__heavy").join(light, keys)
    return hot.unionByName(cold)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def identity(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """(the id as text, a hash of the text): what tells rows apart.  Rows that agree in both are copies."""
    return F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null")), F.xxhash64(text_or_empty(text))


def keep_marked(docs: DataFrame, identities: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that go: of each row of ``identities`` (id, raw, keep, n) none stays, or, if ``keep``,
    one of its n.  Other rows all stay.  Columns of ``docs`` may have any names.

    A bitmap of the hashes of those identities (of a bounded size, so it is sent to all tasks) parts the rows that
    surely stay from the others; only those are shuffled with their texts.
    """
    name, raw, bucket, bits, place = (unused(n, [*docs.columns, "keep"]) for n in ("id", "raw", "bucket", "bits", "place"))
    touched = settle(identities.where(~F.col("keep") | (F.col("n") > 1)).select(F.col("id").alias(name), F.col("raw").alias(raw), "keep"), "touched")
    size = 1 << min(MOST_BITS, max(16, (BITS_EACH * touched.count()).bit_length()))
    hashed = F.pmod(F.xxhash64(name, raw), F.lit(size))
    put = {bucket: (hashed / F.lit(BITMAP)).cast("int"), place: (hashed % F.lit(BITMAP)).cast("int")}
    bitmaps = touched.withColumns(put).groupBy(bucket).agg(F.bitmap_construct_agg(F.col(place).cast("long")).alias(bits))
    own_id, own_raw = identity(text=text)
    keyed = docs.select("*", own_id.alias(name), own_raw.alias(raw)).withColumns(put).join(F.broadcast(bitmaps), bucket, "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, F.col(place) % 8).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    maybe = settle(keyed.where(hit).select(*docs.columns, name, raw), "maybe")
    stays = maybe.join(touched, [name, raw], "left_anti").select(*docs.columns)
    one = maybe.join(touched.where("keep").select(name, raw), [name, raw], "left_semi").dropDuplicates([name, raw]).select(*docs.columns)
    return keyed.where(~hit).select(*docs.columns).unionByName(stays).unionByName(one)


def unused(name: str, taken: Sequence[str]) -> str:
    """A column name like ``name`` that none of ``taken`` equals, in any case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name
