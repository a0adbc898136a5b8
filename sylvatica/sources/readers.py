"""Readers.  Schemas are given, never inferred; blank and null spellings are settled at the edge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sylvatica.functions.payloads import content_hash
from sylvatica.functions.text import blank_to_null, first_filled, setting
from sylvatica.operators.releases import Release
from sylvatica.schemas import FRAME, OBSERVATION_CSV, RELEASE_NAME, RELEASE_ROW, RELEASE_TABLES

#: Texts that a CSV column means null by.
NULL_TEXTS = ("", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "n/a", "<NA>", "#N/A", "-nan", "-NaN", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "#N/A N/A", "#NA")


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str | StructType, header: bool = True, null_texts: Sequence[str] = NULL_TEXTS) -> DataFrame:
    """A CSV table with quoted line breaks; texts that mean null become null."""
    df = spark.read.schema(schema).option("header", header).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    texts = [name for name, kind in df.dtypes if kind == "string"]
    return df.withColumns({c: F.when(~F.col(c).isin(*null_texts), F.col(c)) for c in texts}) if null_texts else df


def read_headed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table whose columns are named by its first line, all as text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def observation_frames(observations: DataFrame, limit: int | None = 100, order: str = "__row") -> DataFrame:
    """Frames from observation rows: rows without a picture or an id are passed over, then ``limit`` are taken in order.

    ``id`` counts before ``observation_id`` unless it is empty; an id of white space alone loses its row.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    names = [f.split()[0] for f in OBSERVATION_CSV.split(", ")]
    rows = observations.select(*[F.col(c) if c in observations.columns else F.lit(None).cast("string").alias(c) for c in names], *([order] if order in observations.columns else []))
    if order not in rows.columns:
        rows = rows.withColumn(order, F.monotonically_increasing_id())
    species = F.coalesce(first_filled(F.col("scientific_name"), F.col("species_guess")), F.lit(""))
    found = rows.select(
        first_filled(F.col("id"), F.col("observation_id")).alias("observation_id"), F.coalesce(blank_to_null(F.col("image_url")), F.lit("")).alias("image_url"),
        F.when(species != "", species).alias("species_name"), blank_to_null(F.col("photo_id")).alias("photo_id"), blank_to_null(F.col("license")).alias("license"),
        blank_to_null(F.col("observed_on")).alias("captured_at"), order,
    ).where((F.col("image_url") != "") & (F.col("observation_id") != ""))
    if limit is not None:
        found = found.orderBy(order).limit(limit)
    null = lambda name: F.lit(None).cast("string").alias(name)
    full = found.select("*", F.coalesce("species_name", "observation_id").alias("subject_id"), null("image_sha256"), null("local_path"), F.lit(0).alias("frame_index"))
    return full.select(*[f.split()[0] for f in FRAME.split(", ")])


def read_observation_frames(spark: SparkSession, path: str, limit: int | None = 100) -> DataFrame:
    return observation_frames(read_headed_csv(spark, path), limit)


def read_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A JSON document (a batch, a manifest, a catalogue, a gallery) as one row."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Earlier results in Parquet, with the ``batch`` that wrote them; none where the folder does not exist yet.

    ``schema`` is the newest one: files of older runs lack the columns added since, which are null for them.
    """
    whole = f"{schema}, batch string"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where) or not files.listStatus(where):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path)


def results_of(results: DataFrame, rows: DataFrame, partition: str = "trial_id", most: int = 1000) -> DataFrame:
    """The results of the trials that ``rows`` belong to: other trials' folders are not read (all are, beyond ``most`` trials)."""
    told = [r[0] for r in rows.select(partition).distinct().limit(most + 1).collect()]
    return results if len(told) > most else results.where(F.col(partition).isin(told))


def read_media(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, image_sha256, byte_size) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    plain = F.regexp_replace("path", r"^file:(//)?", "")
    return files.select(plain.alias("path"), content_hash(F.col("content")).alias("image_sha256"), F.col("length").alias("byte_size"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a settings file; of a key set twice the first counts."""
    # a hidden file, which Spark's readers pass over, in any store: opened by itself
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    rows = spark.createDataFrame(list(enumerate(text.splitlines())), "n long, value string")
    lines = rows.select("n", setting(F.col("value")).alias("s")).where(F.col("s").isNotNull())
    return lines.groupBy(F.col("s.key").alias("key")).agg(F.min_by("s.value", "n").alias("value"))


def new_settings(settings: DataFrame, have: DataFrame) -> DataFrame:
    """Settings whose key is not set already: what is there wins."""
    return settings.join(have.select("key"), "key", "left_anti")


def release_from_text(document: DataFrame) -> Release:
    """A release from one row with its whole text in ``value``, or from a row for each of its parts.

    Each part is a document with every table, whose rows are those of all parts, and with the same manifest.  Tables that are
    missing or no lists raise, and so do manifests that differ.  The hash of several parts is that of their sorted hashes.
    """
    manifest = "struct<contract_version: string, release_id: string, source: struct<devo_name: string, version: string, content_hash: string>>"
    fields = ", ".join([f"manifest: {manifest}", *[f"`{RELEASE_TABLES[name]}`: array<struct<{_colons(row)}>>" for name, row in RELEASE_ROW.items()]])
    parsed = document.select(F.from_json("value", f"struct<{fields}>").alias("d"), content_hash(F.col("value")).alias("data_hash"))
    missing = [F.when(F.col(f"d.{table}").isNull(), F.lit(f"table {table}")) for table in RELEASE_TABLES.values()]
    missing += [F.when(F.col(f"d.manifest.{key}").isNull(), F.lit(f"manifest {key}")) for key in ("contract_version", "release_id", "source")]
    missing += [F.when(F.col(f"d.manifest.source.{key}").isNull(), F.lit(f"source {key}")) for key in (RELEASE_NAME, "version", "content_hash")]
    lacks = F.array_join(F.array_compact(F.array(*missing)), ", ")
    checked = parsed.withColumn("d", F.when(lacks == "", F.col("d")).otherwise(F.raise_error(F.concat(F.lit("release is missing: "), lacks)).cast(f"struct<{fields}>")))
    fields_of_head = {
        "release_id": "d.manifest.release_id", "vocabulary_name": f"d.manifest.source.{RELEASE_NAME}", "contract_version": "d.manifest.contract_version",
        "source_version": "d.manifest.source.version", "source_content_hash": "d.manifest.source.content_hash",
    }
    told = checked.select(F.struct(*[F.col(path).alias(name) for name, path in fields_of_head.items()]).alias("m"), "data_hash")
    every = told.agg(F.min("m").alias("m"), F.max("m").alias("other"), F.array_sort(F.collect_list("data_hash")).alias("hashes")).where(F.size("hashes") > 0)  # a hash a part
    same = F.when(F.col("m") == F.col("other"), F.col("m")).otherwise(F.raise_error(F.lit("parts of a release have different manifests")).cast(told.schema["m"].dataType))
    data_hash = F.when(F.size("hashes") == 1, F.get("hashes", F.lit(0))).otherwise(content_hash(F.array_join("hashes", "\n")))
    head = every.select(same.alias("m"), data_hash.alias("data_hash")).select("m.*", "data_hash")
    table = lambda name: checked.select(F.inline(F.col(f"d.{RELEASE_TABLES[name]}")))
    return Release(head, table("registry"), table("feature_values"), table("taxa"), table("claims"))


def _colons(row: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (field.split(" ", 1) for field in row.split(", ")))


def read_release(spark: SparkSession, path: str) -> Release:
    """A release in one file, or in a folder of files that are its parts: a task takes a file, so the rows of a large one belong in many."""
    return release_from_text(spark.read.text(path, wholetext=True).select("value"))
