"""Sinks: overwritten tables, append-only results, and documents that are written once."""

from __future__ import annotations

import re
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_results(df: DataFrame, path: str, batch: str, partition: str = "trial_id") -> None:
    """Put the rows of one batch into a results table: a folder per batch, and in it one per trial.

    A batch that is written again, after a failure or by mistake, takes the place of what it wrote before, so results are there
    once however often a job runs.  A job that fails on the way leaves a batch without its rows, not with some of them twice.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
        raise ValueError(f"no name for a folder: {batch!r}")
    df.write.mode("overwrite").partitionBy(partition).parquet(f"{path}/batch={batch}")


def write_once(df: DataFrame, path: str) -> None:
    """Write JSON; a target that exists is an error and stays as it is.

    Of several writers at once one wins: each must first create the same claim beside the target, which the file system
    lets only one do, and holds it while it writes.  A writer that dies leaves its claim, which the next ones name.
    """
    claim = f"{path.rstrip('/')}.claim"
    where, files = _file(df.sparkSession, claim)
    if not _created(df.sparkSession, where, files):
        raise FileExistsError(f"{path} is being written, or its writer died: {claim} exists")
    try:
        df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    finally:
        files.delete(where, False)


def _file(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _created(spark: SparkSession, where: Any, files: Any) -> bool:
    """Create an empty file unless there is one, in one step of the file system."""
    jvm = spark.sparkContext._jvm
    whole = files.makeQualified(where)
    files.mkdirs(whole.getParent())
    try:
        if whole.toUri().getScheme() == "file":  # its Hadoop file system looks first and creates later
            jvm.java.nio.file.Files.createFile(jvm.java.io.File(whole.toUri().getPath()).toPath(), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            files.create(whole, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def map_document(pairs: DataFrame, key: str = "key", value: str = "path") -> DataFrame:
    """One row: the pairs as a JSON object, keys sorted.  For documents of a bounded size."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value))))
    return pairs.agg(F.to_json(entries).alias("value"))


def _literal(value: Any) -> Column:
    if isinstance(value, dict):
        return F.struct(*[_literal(v).alias(k) for k, v in sorted(value.items())])
    if isinstance(value, (list, tuple)):
        return F.array(*[_literal(v) for v in value])
    return F.lit(value)


def headed_rows(rows: DataFrame, head: dict[str, Any]) -> DataFrame:
    """Each row with the fields that are the same for the whole document: a document of any size stays spread."""
    return rows.withColumns({k: _literal(v) for k, v in head.items()})


def single_document(rows: DataFrame, name: str, head: dict[str, Any], order: str) -> DataFrame:
    """One row: the head and the list of all rows under ``name``, fields sorted.  For documents of a bounded size."""
    names = sorted(c for c in rows.columns)
    listed = rows.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*names).alias("r")))).alias("l"))
    fields = {k: _literal(v) for k, v in head.items()} | {name: F.transform("l", lambda x: x["r"])}
    return listed.select(*[fields[k].alias(k) for k in sorted(fields)])


def metadata(spark: SparkSession, **fields: Any) -> DataFrame:
    """One row of a run's metadata: command, commit, versions."""
    return spark.range(1).select(*[_literal(v).alias(k) for k, v in fields.items()])
