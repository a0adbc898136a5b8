"""The corpus pipeline: each stage applies one of the operators of ``sylvatica.llm`` to what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result to the shared
folder and gives it to the next.  All stages but the last return the columns of ``documents``.

Defined cases are those of the operators: null and empty texts pass all stages (they are not toxic, equal
empty texts are one group, and an empty text packs into its end id); rows are told apart by their texts as well as
their doc_ids, which may repeat or be null; texts are whole in every stage, however long; an empty table passes as one;
columns beside those of documents, whatever their names, go through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvatica.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from sylvatica.llm.storage import discard, settle, tidy
from sylvatica.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half, by a model fitted on the labelled ones among them."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return near_dedup.keep_one(docs, near_dedup.Rule(size=5, num=80, den=100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the mix asks."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their token ids, in power-of-two sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages train a model, hash shingles and tokenize: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:  # what the stage read, which nothing else does
            discard(before)
        before = docs
        tidy(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
