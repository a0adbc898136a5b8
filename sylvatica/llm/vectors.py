"""What the operators on tables of vectors share: the rows that take part, and batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvatica.llm.storage import settle


def finite(column: str) -> Column:
    """Whether a vector is there and all of its components are numbers."""
    each = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(column).isNotNull() & F.coalesce(each, F.lit(False))


def numbered(vectors: DataFrame, identifier: str, vector: Column, column: str, label: str, *more: Column) -> DataFrame:
    """The rows with finite vectors, written once: row (a number of its own), id, size, v, and ``more``."""
    kept = vectors.where(finite(column)).select(F.monotonically_increasing_id().alias("row"), F.col(identifier).cast("long").alias("id"), F.size(column).alias("size"), vector.alias("v"), *more)
    return settle(kept, label)


def lengths(rows: DataFrame) -> list[int]:
    """The lengths of vectors that a table holds: one, as a rule."""
    return sorted(r["size"] for r in rows.groupBy("size").count().collect())


def matrix(column: pa.Array, size: int, kind: type = np.int64) -> np.ndarray:
    """An Arrow column of lists, all of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), size)
