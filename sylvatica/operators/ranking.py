"""Ranking of proposals within a group: keep all rows with a rank, or keep the best k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The selection scopes and the columns that make a group under each.
SCOPES = {"category": ("category_id",), "subject-category": ("subject_id", "category_id")}


def scope_keys(scope: str, names: dict[str, str] | None = None) -> list[str]:
    """The columns that a scope groups by; ``names`` renames them."""
    if scope not in SCOPES:
        raise ValueError("scope must be 'category' or 'subject-category'")
    return [(names or {}).get(key, key) for key in SCOPES[scope]]


def _place(keys: Sequence[str | Column], score: str, tie: str) -> Column:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(tie).asc_nulls_last())
    return F.row_number().over(order)


def rank_within(df: DataFrame, keys: Sequence[str], score: str, tie: str, top_k: int) -> DataFrame:
    """Every row with its ``rank`` in its group (score descending, tie ascending) and ``selected``."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    return df.withColumn("rank", _place(keys, score, tie)).withColumn("selected", F.col("rank") <= top_k)


def best_within(df: DataFrame, keys: Sequence[str], score: str, tie: str, top_k: int) -> DataFrame:
    """The best ``top_k`` rows of each group with their ``rank``.

    The filter on the rank lets Spark drop rows of a group beyond the k-th before the shuffle, so a hot group
    sends k rows from each task.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    return df.withColumn("rank", _place(keys, score, tie)).where(F.col("rank") <= top_k)


def last_n(df: DataFrame, order: str, n: int = 200) -> DataFrame:
    """The n rows that are last by ``order``: a top-k, not a sort of all rows."""
    return df.orderBy(F.col(order).desc()).limit(n)
