"""The live gate: requests checked, proposals ordered, and a decision with its response."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvatica.functions import geometry as G
from sylvatica.functions.payloads import decode_image, usable_free_model
from sylvatica.functions.text import strip

#: The prompt that stands for each layer.
LAYER_PROMPTS = {"growth_form": "whole plant", "leaf": "leaf", "bark": "bark", "stem": "stem", "bud": "bud", "flower": "flower", "fruit": "fruit"}
MOST_PROMPTS, LONGEST_PROMPT, THRESHOLD, LAYER = 10, 80, 0.75, "growth_form"
PATHS = ("/growth-form-gate", "/growth-form-gate/telemetry")
#: Aliases that stand for the first usable free model.
FREE_ALIASES = ("openrouter/free", "openrouter/free-vision")


def layer_prompt(layer: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LAYER_PROMPTS.items() for x in pair]), layer)


def checked_requests(requests: DataFrame) -> DataFrame:
    """Requests (request_id, threshold, layer, prompts, image_base64) with ``active_prompts``, ``image`` and ``detail``:
    what is wrong with a request, or null."""
    asked = F.coalesce("prompts", F.array().cast("array<string>"))
    prompts = F.filter(F.transform(asked, strip), lambda p: p != "")
    filled = requests.withColumns({"threshold": F.coalesce("threshold", F.lit(THRESHOLD)), "layer": F.coalesce("layer", F.lit(LAYER)), "prompts": prompts})
    filled = filled.withColumn("image", decode_image(F.col("image_base64")))
    known = layer_prompt(F.col("layer"))
    given = F.size("prompts") > 0
    detail = (
        F.when(~F.col("threshold").between(0, 1), "threshold must be between 0 and 1")
        .when(F.size("prompts") > MOST_PROMPTS, f"at most {MOST_PROMPTS} probe prompts per request")
        .when(F.exists("prompts", lambda p: F.length(p) > LONGEST_PROMPT), f"probe prompts must be {LONGEST_PROMPT} characters or fewer")
        .when(~given & known.isNull(), F.concat(F.lit("unsupported organ layer: "), F.col("layer")))
        .when(F.col("image").isNull(), "image is not base64")
    )
    return filled.withColumns({"active_prompts": F.when(given, F.col("prompts")).otherwise(F.array(known)), "detail": detail})


def gate_proposals(segments: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Segments of a request with ``confidence`` and ``proposal_id``: a row each."""
    name = F.concat(F.lit("live-"), F.col("layer"), F.lit("-"), F.col(ordinal).cast("string"))
    return segments.select(*keys, ordinal, "layer", "threshold", name.alias("proposal_id"), G.gate_confidence(F.col("detection_confidence"), F.col("mask_quality")).alias("confidence"))


def gate_decisions(proposals: DataFrame, requests: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Per request: proposals by confidence (equal ones as detected), the best, and whether the gate opens.

    A request without proposals has confidence 0 and a closed gate.
    """
    item = F.struct((-F.col("confidence")).alias("o"), F.col(ordinal).alias("i"), "proposal_id", "confidence")
    listed = proposals.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("p"))
    joined = requests.join(listed, keys, "left").withColumn("best", F.get("p", F.lit(0)))
    confidence = F.coalesce(F.col("best.confidence"), F.lit(0.0))
    return joined.select(
        *keys, "layer", "threshold", confidence.alias("confidence"), F.coalesce(F.col("best.confidence") >= F.col("threshold"), F.lit(False)).alias("gate_open"),
        F.col("best.proposal_id").alias("best_proposal_id"), F.coalesce(F.size(F.coalesce("p", F.array().cast("array<struct<o:double,i:int,proposal_id:string,confidence:double>>"))), F.lit(0)).alias("proposal_count"),
        F.transform("p", lambda x: x["proposal_id"]).alias("proposal_ids"),
    )


def response_status(path: Column, method: Column, authorised: Column, detail: Column) -> Column:
    """The status of an answered request: 204, 404, 401, 422, 202 or 200."""
    telemetry = path == PATHS[1]
    known = F.when(method == "GET", telemetry).otherwise(path.isin(*PATHS))
    return (
        F.when(method == "OPTIONS", 204).when(~known, 404).when(~authorised, 401).when(detail.isNotNull(), 422)
        .when(telemetry & (method == "POST"), 202).otherwise(200)
    )


def response_body(status: Column, detail: Column, decision: Column, events: Column) -> Column:
    """The JSON body of an answer; null where there is none.  ``decision`` is a struct, ``events`` the list that telemetry
    holds (its length is told for an event taken in)."""
    told = F.to_json(F.struct(F.when(status == 404, "not found").when(status == 401, "invalid or missing X-API-Key").otherwise(detail).alias("detail")))
    accepted = F.to_json(F.struct(F.lit(True).alias("accepted"), F.size(events).alias("events")))
    listed = F.to_json(F.struct(events.alias("events"), F.size(events).alias("count")))
    return (
        F.when(status == 204, F.lit(None)).when(status.isin(401, 404, 422), told).when(status == 202, accepted)
        .when(decision.isNotNull(), F.to_json(decision)).otherwise(listed)
    )


#: Header fields of an answer, and those of an answer to OPTIONS.
RESPONSE_HEADERS = {"Content-Type": "application/json", "Access-Control-Allow-Origin": "*"}
OPTIONS_HEADERS = {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Headers": "Content-Type, X-API-Key", "Access-Control-Allow-Methods": "POST, OPTIONS"}


def response_headers(status: Column, body: Column) -> Column:
    """The header fields of an answer as a map; Content-Length counts the bytes of the body."""
    fixed = lambda fields: [F.lit(x) for pair in fields.items() for x in pair]
    length = F.octet_length(F.coalesce(body, F.lit(""))).cast("string")
    return F.when(status == 204, F.create_map(*fixed(OPTIONS_HEADERS))).otherwise(F.create_map(*fixed(RESPONSE_HEADERS), F.lit("Content-Length"), length))


def received_requests(raw: DataFrame) -> DataFrame:
    """Requests as ``checked_requests`` reads them, from raw ones (request_id, method, path, key, body: JSON text).

    ``prompts`` may be one text; ``authorised`` is told by ``authorise``; a body that is no JSON object has ``malformed``.
    """
    one = F.from_json("body", "struct<threshold: string, layer: string, prompts: string, image_base64: string>")
    listed = F.from_json(F.col("__r.prompts"), "array<string>")
    parsed = raw.withColumn("__r", one).withColumn("malformed", ~F.coalesce(F.json_object_keys("body").isNotNull(), F.lit(False)))
    single = F.when(F.col("__r.prompts") != "", F.array("__r.prompts"))
    return parsed.select(
        *raw.columns, F.col("__r.threshold").try_cast("double").alias("threshold"), F.col("__r.layer").alias("layer"),
        F.when(F.col("__r.prompts").startswith("["), listed).otherwise(single).alias("prompts"), F.col("__r.image_base64").alias("image_base64"), "malformed",
    )


def authorise(key: Column, required: str | None) -> Column:
    """Whether a request's key opens the gate; without a required key every request does."""
    return F.lit(True) if not required else F.coalesce(F.sha2(key, 256) == F.lit(hashlib.sha256(required.encode()).hexdigest()), F.lit(False))


def stamped_events(events: DataFrame, received_at: Column) -> DataFrame:
    """Events with their time of arrival; an event that brings its own keeps it."""
    own = F.col("received_at") if "received_at" in events.columns else F.lit(None).cast("string")
    return events.withColumn("received_at", F.coalesce(own, received_at))


def resolve_models(asked: DataFrame, catalogue: DataFrame, override: str = "", require_image: bool = False) -> DataFrame:
    """(model, resolved): the model itself, or for an alias the override or the first usable free model.

    ``catalogue``: ordinal, id, name, pricing, architecture.  ``resolved`` is null where an alias has none.
    """
    row = F.struct("id", "name", "pricing", "architecture")
    first = catalogue.where(usable_free_model(row, require_image)).agg(F.min_by("id", "ordinal").alias("free"))
    chosen = F.lit(override.strip()) if override.strip() else F.col("free")
    name = strip(F.col("model"))
    return asked.crossJoin(F.broadcast(first)).select("model", F.when(name.isin(*FREE_ALIASES), chosen).otherwise(name).alias("resolved"))  # one row
