"""Vocabulary releases: integrity of their tables, and claims as cases that keep their release's identity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvatica.functions.answers import is_correct
from sylvatica.operators.frames import broken_rules, insist, key_violations
from sylvatica.schemas import OUTCOMES, RELEASE_NAME


@dataclass(frozen=True)
class Release:
    """The tables of a release.  ``manifest`` has one row: release_id, vocabulary_name, contract_version,
    source_version, source_content_hash and data_hash."""

    manifest: DataFrame
    registry: DataFrame
    feature_values: DataFrame
    taxa: DataFrame
    claims: DataFrame


def claim_violations(claims: DataFrame, taxa: DataFrame, values: DataFrame, name: str = "taxon_name") -> DataFrame:
    """(rule, subject, vocab_id) of claims whose taxon or value is unknown, or whose feature is not its value's."""
    known_taxa = taxa.select(F.col(name).alias("__taxon")).distinct()
    known = values.select(F.col("vocab_id").alias("__value"), F.col("feature_name").alias("__feature")).distinct()
    joined = claims.join(known_taxa, claims[name] == F.col("__taxon"), "left").join(known, claims["vocab_id"] == F.col("__value"), "left")
    rule = (
        F.when(F.col("__taxon").isNull(), "unknown taxon").when(F.col("__value").isNull(), "unknown value")
        .when(~F.col("__feature").eqNullSafe(claims["feature_name"]), "feature is not its value's")
    )
    return joined.select(rule.alias("rule"), claims[name].alias("subject"), claims["vocab_id"].alias("vocab_id")).where(F.col("rule").isNotNull())


def release_violations(release: Release) -> DataFrame:
    """(rule, subject) of everything that a release must not hold."""
    manifest = release.manifest.select("vocabulary_name")
    names = release.registry.agg(F.array_sort(F.collect_set(RELEASE_NAME)).alias("names")).crossJoin(manifest)  # one row each
    registry = names.where(~F.col("names").eqNullSafe(F.array("vocabulary_name"))).select(F.lit("registry is not the manifest's vocabulary").alias("rule"), F.array_join("names", ",").alias("subject"))
    named = release.claims.join(F.broadcast(manifest), ~F.col(RELEASE_NAME).eqNullSafe(F.col("vocabulary_name")))  # one row
    other = named.select(F.lit("claim of another vocabulary").alias("rule"), F.col("taxon_name").alias("subject"))
    keys = key_violations(release.feature_values, "vocab_id", "feature value").unionByName(key_violations(release.taxa, "taxon_name", "taxon")).select("rule", "subject")
    return registry.unionByName(other).unionByName(keys).unionByName(claim_violations(release.claims, release.taxa, release.feature_values).select("rule", "subject"))


def validate_release(release: Release) -> Release:
    insist(release_violations(release), "release")
    return release


def experiment_cases(release: Release) -> DataFrame:
    """A case for every claim: nothing of another release is mixed in, and no identifier is new."""
    values = release.feature_values.select("vocab_id", "source_value_id")
    taxa = release.taxa.select("taxon_name", "source_taxon_id")
    joined = release.claims.join(values, "vocab_id").join(taxa, "taxon_name")
    meta = release.manifest.select("vocabulary_name", F.col("release_id").alias("vocabulary_release_id"))
    return joined.crossJoin(F.broadcast(meta)).select(  # the manifest is one row
        "vocabulary_name", "vocabulary_release_id", F.col("taxon_name").alias("canonical_taxon_id"), F.col("feature_name").alias("canonical_feature_id"),
        F.col("vocab_id").alias("canonical_value_id"), "source_taxon_id", "source_value_id", "assertion_source", "source_context_id",
    )


def cases_for_taxon(release: Release, taxon: str) -> DataFrame:
    if release.taxa.where(F.col("taxon_name") == taxon).isEmpty():
        raise KeyError(f"unknown taxon: {taxon}")
    return experiment_cases(release).where(F.col("canonical_taxon_id") == taxon)


def provenance(release: Release, trial_id: str, model: str, adapter_version: str, started_at: str) -> DataFrame:
    """The one row that every record of a trial carries.  The time is given by the caller."""
    given = [F.lit(v).alias(k) for k, v in (("trial_id", trial_id), ("started_at", started_at), ("model", model), ("adapter_version", adapter_version))]
    return release.manifest.select(*given, "release_id", F.col("data_hash").alias("release_data_hash"), "vocabulary_name", "contract_version")


def record_violations(records: DataFrame) -> DataFrame:
    """(rule, subject) of trial records whose case or prediction contradicts them."""
    classified = F.col("parsed_outcome") == "classified"
    predicted = F.coalesce(F.col("predicted_value_id"), F.lit("")) != ""
    return broken_rules(records, "trial_id", {
        "release of the case is the trial's": F.col("case_release_id").eqNullSafe(F.col("release_id")),
        "vocabulary of the case is the trial's": F.col("case_vocabulary_name").eqNullSafe(F.col("vocabulary_name")),
        "outcome is known": F.col("parsed_outcome").isin(*OUTCOMES),
        "a classification has a prediction": ~classified | predicted,
        "only a classification has a prediction": classified | F.col("predicted_value_id").isNull(),
    })


def classification_metrics(records: DataFrame, outcome: Column, predicted: Column, truth: Column, keys: list[str] | None = None) -> DataFrame:
    """Counts, accuracy among classifications alone and coverage; null where nothing is there to divide by."""
    classified, right = outcome == "classified", F.coalesce(is_correct(outcome, predicted, truth), F.lit(False))
    counts = records.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(classified).alias("classified_records"), F.count_if(outcome == "abstained").alias("abstained_records"),
        F.count_if(outcome == "invalid").alias("invalid_records"), F.count_if(right).alias("correct_classifications"),
    )
    return counts.withColumns({
        "classification_accuracy": F.try_divide("correct_classifications", "classified_records"),
        "classification_coverage": F.try_divide("classified_records", "total_records"),
    })
