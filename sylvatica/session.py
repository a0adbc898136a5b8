"""Session construction and the table reader shared by every registered query."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sylvatica", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter's session is used as it is."""
    cores = cores or os.cpu_count() or 4
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='sylvatica-')}",  # one machine, so its own disk is shared
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables.  Read through Spark only: the folder may be in any store."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``; a local session without one gets a folder of its own.

    Raises where it is not set and tasks run on other machines, as their disks are not shared.
    """
    if not spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='sylvatica-')}")
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed and its plan cut, in the folder that the cluster shares."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
