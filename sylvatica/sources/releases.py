"""Many release documents in many files, by VARIANT: what is broken becomes rows, and the rows of good ones stay spread.

A document is parsed once into a VARIANT, whose fields are read without a schema for the whole; a list is then spread
over rows.  So a release whose table is missing, or is no list, is told apart from one whose table is empty, and
stops none of the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvatica.functions.payloads import content_hash
from sylvatica.schemas import RELEASE_NAME, RELEASE_ROW, RELEASE_TABLES
from sylvatica.session import settled

_MANIFEST = {
    "release_id": "$.manifest.release_id", "contract_version": "$.manifest.contract_version", "vocabulary_name": f"$.manifest.source.{RELEASE_NAME}",
    "source_version": "$.manifest.source.version", "source_content_hash": "$.manifest.source.content_hash",
}


@dataclass(frozen=True)
class Releases:
    """``heads``: a row per document (path, the fields of its manifest, data_hash).  ``violations``: (path, rule, subject).
    ``table(name)``: the rows of one table of all documents without violations, with their ``release_id``."""

    heads: DataFrame
    violations: DataFrame
    good: DataFrame

    def table(self, name: str) -> DataFrame:
        fields = [field.split(" ", 1) for field in RELEASE_ROW[name].split(", ")]
        listed = self.good.select("release_id", F.col("tables")[name].alias("v"))
        each = listed.select("release_id", F.explode(F.variant_get("v", "$", "array<variant>")).alias("row"))
        return each.select("release_id", *[F.try_variant_get("row", f"$.{field}", kind).alias(field) for field, kind in fields])


def _kind(document: Column, path: str) -> Column:
    """ARRAY, OBJECT, VOID, a scalar's type, or null where nothing is there."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(document, path, "variant")), "^[A-Z]+", 0)


def releases_from_texts(documents: DataFrame) -> Releases:
    """Of rows (path, value: a whole document).  A document is one row until its lists are spread."""
    parsed = documents.select("path", F.try_parse_json("value").alias("d"), content_hash(F.col("value")).alias("data_hash"))
    heads = {name: F.try_variant_get("d", path, "string") for name, path in _MANIFEST.items()}
    kinds = {name: _kind(F.col("d"), f"$.{table}") for name, table in RELEASE_TABLES.items()}
    problem = lambda rule, subject: F.struct(F.lit(rule).alias("rule"), F.lit(subject).alias("subject"))
    tests = [F.when(F.col("d").isNull(), problem("the document is no JSON", "document"))]
    known = F.col("d").isNotNull()
    tests += [F.when(known & F.col(name).isNull(), problem("the manifest lacks a field", name)) for name in heads]
    for name, table in RELEASE_TABLES.items():
        kind = F.col("kinds")[name]
        tests += [F.when(known & (kind.isNull() | (kind == "VOID")), problem("a table is missing", table)), F.when(known & ~kind.isin("ARRAY", "VOID"), problem("a table is no list", table))]
    tables = F.struct(*[F.try_variant_get("d", f"$.{table}", "variant").alias(name) for name, table in RELEASE_TABLES.items()])
    told = parsed.withColumns(heads).withColumn("kinds", F.struct(*[k.alias(name) for name, k in kinds.items()]))
    checked = settled(told.select("path", "data_hash", *heads, F.array_compact(F.array(*tests)).alias("problems"), tables.alias("tables")))
    violations = checked.select("path", F.explode("problems").alias("p")).select("path", "p.rule", "p.subject")
    return Releases(checked.select("path", *heads, "data_hash"), violations, checked.where(F.size("problems") == 0))


def read_releases(spark: SparkSession, path: str) -> Releases:
    """All documents under a folder and the folders in it, a file each."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return releases_from_texts(files)
