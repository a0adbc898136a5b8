"""Model evaluation: tasks, what is already done, the two-phase step and the calibration of references."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvatica.functions import answers as A
from sylvatica.functions.payloads import parts_json
from sylvatica.operators.calls import told_apart
from sylvatica.operators.frames import first_by_key, last_by_key
from sylvatica.operators.keys import SPECIES, unpivoted_truth

TASK_KEY = ["model", "observation_id", "feature"]
CALIBRATION_KEY = ["model", "feature_value", "prompt_type"]
PROMPT_TYPES = ("existence", "agreement", "blind_mc")
#: How an answer was read, as results tell it.
P1_RULE = "parse_ync: startswith YES -> YES; startswith NO -> NO; contains INC -> INCONCLUSIVE; else INCONCLUSIVE"
P2_RULE = (
    "parse_mc: exact value match; else substring value match; else contains 'cannot determine' -> INCONCLUSIVE; "
    "else leading option number; else INCONCLUSIVE"
)
P2_SKIPPED = "P2 skipped because P1 was not YES; parsed as INCONCLUSIVE"

Call = Callable[[str, list[dict[str, str]]], str]


def check_features(features: Sequence[str]) -> None:
    unknown = [f for f in features if f not in A.PRIMARY_FEATURES]
    if unknown:
        raise ValueError(f"unsupported features: {', '.join(unknown)}")


def each(df: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """Every row once for each value: a generator over a literal, not a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def tasks(sample: DataFrame, features: Sequence[str], models: Sequence[str], limit: int | None = None, order: str = "observation_id") -> DataFrame:
    """model x observation x feature; of rows that repeat an observation the first by species counts, which is found before they multiply."""
    check_features(features)
    if limit is not None:
        sample = sample.orderBy(F.col(order).asc_nulls_last()).limit(limit)
    rows = sample.withColumn("observation_id", F.col("observation_id").cast("string"))
    one = first_by_key(rows, ["observation_id"], [F.col(c).asc_nulls_last() for c in ("species_inat", SPECIES) if c in rows.columns])
    return each(each(one, "feature", list(dict.fromkeys(features))), "model", list(dict.fromkeys(models)))


def remaining(rows: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` whose key has no result yet; keys are compared as strings."""
    left = rows.withColumns({f"__{k}": F.col(k).cast("string") for k in key})
    right = done.select(*[F.col(k).cast("string").alias(f"__{k}") for k in key]).distinct()
    return left.join(right, [f"__{k}" for k in key], "left_anti").select(*rows.columns)


def options(refs: DataFrame) -> DataFrame:
    """(feature, options): each feature's values in order, described by the last reference of the same value.

    The order is that of ``ordinal``, which ``refs`` must have (``frames.numbered_by`` gives one): rows have no order of their own.
    """
    if "ordinal" not in refs.columns:
        raise ValueError("references need an ordinal, by which options are numbered")
    last = last_by_key(refs.select("feature", "feature_value", "reference_description", "reference_illustration_path", "ordinal"), ["feature", "feature_value"], "ordinal")
    material = last.select("feature", "feature_value", "reference_description", "reference_illustration_path")
    option = F.struct(
        F.col("feature_value").alias("value"), F.coalesce("reference_description", F.lit("")).alias("description"), F.lit(None).cast("string").alias("photo"),
        F.when(F.col("reference_illustration_path") != "", F.col("reference_illustration_path")).alias("illustration"),
    )
    joined = refs.select("feature", "feature_value", "ordinal").where(F.col("feature").isNotNull()).join(material, ["feature", "feature_value"])
    listed = joined.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("ordinal", option.alias("option")))).alias("o"))
    return listed.select("feature", F.transform("o", lambda x: x["option"]).alias("options"))


def feature_values(pairs: DataFrame) -> DataFrame:
    """(feature, values): the values of each feature, in order; a value may stand twice."""
    known = pairs.where(F.col("feature").isNotNull() & F.col("value").isNotNull())
    return known.groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("values"))


def model_call(call: Call) -> Callable[[Column, Column], Column]:
    """A Column function (model, parts) -> answer around a Python callable whose failures end the job; with
    ``calls.isolated_call`` they are rows.

    Marked as non-deterministic, so that no rule of the optimizer evaluates a call twice.
    """

    @F.pandas_udf("string")
    def ask(model: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([call(m, [dict(p) for p in ps]) for m, ps in zip(model, parts, strict=True)], dtype=object)

    return ask.asNondeterministic()


def mock_call(model: Column, parts: Column) -> Column:
    return A.mock_answer(parts)


def command_call(command: str, timeout: float = 75.0) -> Call:
    """A callable that runs a command: JSON on its input, the answer on its output."""
    if not command.strip():
        raise ValueError("a command is required")

    def call(model: str, parts: list[dict[str, str]]) -> str:
        plain = [p["value"] if p["kind"] == "text" else {"image": p["value"]} for p in parts]
        try:
            done = subprocess.run(command, input=json.dumps({"model": model, "parts": plain}), text=True, shell=True, capture_output=True, check=False, timeout=timeout)
        except subprocess.TimeoutExpired as late:
            raise RuntimeError(f"model command timed out after {timeout:g}s: {command}") from late
        if done.returncode:
            raise RuntimeError(done.stderr.strip() or f"command failed: {command}")
        return done.stdout.strip()

    return call


def with_truth(rows: DataFrame, paths: DataFrame, features: Sequence[str]) -> DataFrame:
    """Tasks with ``true_value``; a task whose species or feature has none is dropped."""
    return rows.join(unpivoted_truth(paths, features), ["species_inat", "feature"])


def first_phase(rows: DataFrame, ask: Callable[[Column, Column], Column]) -> DataFrame:
    """Tasks with the first prompt, its answer and how it was read.

    Write the result before ``second_phase`` reads it: the answers are then asked for once.
    """
    asked = rows.withColumn("p1_parts", A.existence_prompt(F.col("feature"), F.col("photo_url"), F.col("true_value")))
    answered = _answered(asked, "p1_raw", ask(F.col("model"), F.col("p1_parts")))
    parsed = F.when(F.col("p1_raw").isNotNull(), A.parse_yes_no(F.col("p1_raw"))) if "error" in answered.columns else A.parse_yes_no(F.col("p1_raw"))
    return answered.withColumn("p1_parsed", parsed).withColumn("p1_parse_rule", F.lit(P1_RULE))


def _answered(rows: DataFrame, name: str, answer: Column) -> DataFrame:
    """``rows`` with the answer, and with ``error`` where ``calls.isolated_call`` gives it beside the answer."""
    kind = rows.select(answer.alias(name)).schema[name].dataType.typeName()
    return told_apart(rows, name, answer) if kind == "struct" else rows.withColumn(name, answer)


def second_phase(rows: DataFrame, choices: DataFrame, values: DataFrame, ask: Callable[[Column, Column], Column]) -> DataFrame:
    """The choice among options for rows answered YES; the others are INCONCLUSIVE without a call.

    The two kinds of rows are parted by filters, as an expensive function inside ``when`` may run for all rows.
    ``choices`` and ``values`` have a row per feature; Spark sends them to every task only if their size allows.
    """
    joined = rows.join(choices, "feature", "left").join(values, "feature", "left")
    yes = joined.where(F.col("p1_parsed") == "YES")
    none = F.array().cast("array<struct<value:string,description:string,photo:string,illustration:string>>")
    asked = yes.withColumn("p2_parts", A.choice_prompt(F.col("feature"), F.coalesce("options", none), F.col("photo_url")))
    answered = _answered(asked, "p2_raw", ask(F.col("model"), F.col("p2_parts")))
    read = answered.withColumn("p2_parsed", A.parse_choice(F.col("p2_raw"), F.coalesce("values", F.array().cast("array<string>")))).withColumn("p2_parse_rule", F.lit(P2_RULE))
    skipped = joined.where(~F.coalesce(F.col("p1_parsed") == "YES", F.lit(False))).withColumns({
        "p2_parts": F.array().cast("array<struct<kind:string,value:string>>"), "p2_raw": F.lit(""), "p2_parsed": F.lit(A.INCONCLUSIVE), "p2_parse_rule": F.lit(P2_SKIPPED),
    })
    both = read.unionByName(skipped, allowMissingColumns=True).drop("options", "values")
    if "error" not in both.columns:
        return both
    failed = F.col("error").isNotNull()  # a failed task has no reading
    return both.withColumns({c: F.when(~failed, F.col(c)) for c in ("p2_raw", "p2_parsed", "p2_parse_rule")})


def scored(rows: DataFrame) -> DataFrame:
    """A failed task, which has no reading, has no score."""
    score = A.step_score(F.col("p2_parsed"), F.col("true_value"))
    if "error" in rows.columns:
        score = F.when(F.col("error").isNull(), score)
    return rows.withColumns({"feature_correct": score["feature_correct"], "committed": score["committed"]})


def step_results(rows: DataFrame, trial_id: str, started_at: str, mode: str, sample_limit: str, features_requested: str) -> DataFrame:
    """Scored tasks in the 24 columns of a result file, and ``error`` where calls can fail alone."""
    given = {"trial_id": trial_id, "run_started_at": started_at, "model_mode": mode, "sample_limit": sample_limit, "features_requested": features_requested}
    out = rows.withColumns({k: F.lit(v) for k, v in given.items()})
    out = out.withColumns({"p1_prompt_parts_json": parts_json(F.col("p1_parts")), "p2_prompt_parts_json": parts_json(F.col("p2_parts"))})
    return out.select(
        "trial_id", "run_started_at", "model_mode", "model", "sample_limit", "features_requested", "observation_id", "photo_id", "photo_url", "taxon_id", "species_inat", SPECIES,
        "feature", "true_value", "p1_prompt_parts_json", "p1_raw", "p1_parsed", "p1_parse_rule", "p2_prompt_parts_json", "p2_raw", "p2_parsed", "p2_parse_rule", "feature_correct", "committed",
        *(["error"] if "error" in out.columns else []),
    )


def calibration_tasks(refs: DataFrame, models: Sequence[str]) -> DataFrame:
    """References of primary features that have a picture x prompt type x model."""
    wanted = refs.where(F.col("feature").isin(*A.PRIMARY_FEATURES) & (F.coalesce("reference_illustration_path", F.lit("")) != ""))
    return each(each(wanted, "prompt_type", PROMPT_TYPES), "model", models)


def calibrated(rows: DataFrame, choices: DataFrame, ask: Callable[[Column, Column], Column]) -> DataFrame:
    """Calibration results.  Rows already done are to be taken out before, so that no call is paid for twice."""
    feature, truth, image, kind = F.col("feature"), F.col("feature_value"), F.col("reference_illustration_path"), F.col("prompt_type")
    joined = rows.join(choices, "feature", "left")
    prompt = (
        F.when(kind == "existence", A.existence_prompt(feature, image, truth))
        .when(kind == "agreement", A.agreement_prompt(feature, truth, F.col("reference_description"), image))
        .otherwise(A.choice_prompt(feature, F.col("options"), image))
    )
    answered = joined.withColumn("raw_response", ask(F.col("model"), prompt))
    parsed = F.when(kind == "blind_mc", A.parse_choice(F.col("raw_response"), F.transform("options", lambda o: o["value"]))).otherwise(A.parse_yes_no(F.col("raw_response")))
    expected = F.when(kind == "blind_mc", truth).otherwise("YES")
    out = answered.withColumn("parsed", parsed).withColumn("expected", expected)
    return out.select("model", "feature", "feature_value", "prompt_type", "raw_response", "parsed", "expected", (F.col("parsed") == F.col("expected")).alias("correct"))


def error_count(results: DataFrame, error: str = "error") -> DataFrame:
    """One row: how many tasks failed.  Failures are rows like any other and are counted after the write."""
    return results.agg(F.count_if(F.col(error).isNotNull()).alias("errors"), F.count(F.lit(1)).alias("tasks"))
