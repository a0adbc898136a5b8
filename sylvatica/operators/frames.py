"""Small general operators on whole DataFrames: missing columns, key checks, violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvatica.session import settled


def ensure_columns(df: DataFrame, names: Sequence[str], default: str = "", sources: Mapping[str, str] | None = None) -> DataFrame:
    """``names`` in that order; a missing one is taken from its column in ``sources`` or filled with ``default``."""
    sources = sources or {}

    def pick(name: str) -> Column:
        if name in df.columns:
            return F.col(name)
        return F.col(sources[name]).alias(name) if sources.get(name) in df.columns else F.lit(default).alias(name)

    return df.select(*[pick(name) for name in names])


def last_by_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys the last by ``order``, as filling a dictionary leaves it."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return kept.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of rows with equal keys the first by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", place).where(F.col("__n") == 1).drop("__n")


def key_violations(df: DataFrame, key: str, label: str) -> DataFrame:
    """(rule, subject, rows): blank and repeated keys."""
    counted = df.groupBy(F.col(key).alias("subject")).agg(F.count(F.lit(1)).alias("rows"))
    blank = F.coalesce(F.col("subject"), F.lit("")) == ""
    rule = F.when(blank, F.lit(f"{label} row is missing {key}")).when(F.col("rows") > 1, F.lit(f"duplicate {label} ID"))
    return counted.withColumn("rule", rule).where(F.col("rule").isNotNull()).select("rule", "subject", "rows")


def broken_rules(df: DataFrame, subject: str, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, subject) for every row and every rule whose test is not true."""
    tests = F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(rule)) for rule, test in rules.items()])
    return df.select(F.explode(F.array_compact(tests)).alias("rule"), F.col(subject).alias("subject"))


def insist(violations: DataFrame, what: str, show: int = 5) -> None:
    """Raise ValueError with the first few violations; the rest stay where they are."""
    found = violations.limit(show).collect()
    if found:
        raise ValueError(f"{what}: " + "; ".join(f"{row['rule']} ({row['subject']})" for row in found))


def numbered_by(df: DataFrame, order: str | Sequence[Column], name: str) -> DataFrame:
    """``df`` with the 0-based ordinal of each row by ``order`` (nulls last), without one sort of all rows in one task.

    Ranges are sorted side by side and written, as their bounds come from a sample that no second run need repeat; the
    counts of each shift the next.
    """
    by = [F.col(order).asc_nulls_last()] if isinstance(order, str) else list(order)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settled(df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("__before", before).drop("__n")  # a row per partition
    within = F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)
    return parts.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + within).drop("__part", "__at", "__before")
