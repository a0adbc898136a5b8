"""From frames to proposed regions: segments, quality, ranking, the nested batch, galleries and manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sylvatica.functions import geometry as G
from sylvatica.functions.floats import python_points
from sylvatica.functions.text import ORGAN_PROMPTS, category_id, file_name, gallery_category, joined_path
from sylvatica.operators.frames import numbered_by
from sylvatica.operators.ranking import best_within, rank_within, scope_keys
from sylvatica.schemas import BATCH_VERSION, FRAME, GALLERY_VERSION, MANIFEST_VERSION, SEGMENT


#: Frames whose regions a task holds as Python objects at once; an Arrow batch, which may have more, is taken in slices.
SLICE = 128


class Segmenter(Protocol):
    """Finds regions.  ``segment`` gets a frame as a dict and the prompts, and gives dicts as in SEGMENT."""

    model_name: str
    model_version: str

    def segment(self, frame: dict[str, Any], prompts: Sequence[str]) -> Sequence[dict[str, Any]]: ...


def segmented(frames: DataFrame, make: Callable[[], Segmenter], prompts: Sequence[str] = ORGAN_PROMPTS) -> DataFrame:
    """Frames with ``segments``, or with ``error_type`` and ``message`` where the segmenter failed.

    ``make`` runs once in a task, so a model is loaded once however many frames follow.  A frame that fails
    becomes a row of its own and stops nothing.  Regions are given back by slices of a batch.
    """
    columns = [f.split()[0] for f in FRAME.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = make()
        for part in (batch.iloc[at : at + SLICE] for batch in batches for at in range(0, len(batch), SLICE)):
            found, kinds, messages = [], [], []
            for frame in part.to_dict("records"):
                try:
                    found.append([_segment(s) for s in segmenter.segment(frame, prompts)])
                    kinds.append(None)
                    messages.append(None)
                except Exception as error:  # noqa: BLE001  any failure is a failed frame
                    found.append(None)
                    kinds.append(type(error).__name__)
                    messages.append(str(error))
            yield part.assign(segments=found, error_type=kinds, message=messages)

    return frames.select(*columns).mapInPandas(run, f"{FRAME}, segments array<{SEGMENT}>, error_type string, message string")


def _segment(raw: dict[str, Any]) -> dict[str, Any]:
    points = [{"x": float(x), "y": float(y)} for x, y in raw["polygon"]]
    return {"stability_score": 0.5, "prompt": None, "detector_label": None} | raw | {"polygon": points}


def register_segmenter(spark: SparkSession, name: str, make: Callable[[], Segmenter], prompts: Sequence[str] = ORGAN_PROMPTS) -> None:
    """A table function for SQL: ``name(TABLE(frames) PARTITION BY observation_id ORDER BY frame_index)``.

    It gives the frame's columns, the ordinal of each region and the region ``s``, or ``error_type`` and ``message`` of a frame
    that fails.  Frames of one observation meet one object, in order; ``make`` runs once in a Python worker.
    """
    columns = [f.split()[0] for f in FRAME.split(", ")]
    fields = [f.split(":")[0].strip() for f in SEGMENT.removeprefix("struct<").split(", ") if ":" in f]
    fields = [f for f in fields if f in ("label", "polygon", "detection_confidence", "mask_quality", "stability_score", "prompt", "detector_label")]
    made: list[Segmenter] = []

    @F.udtf(returnType=f"{FRAME}, ordinal int, s {SEGMENT}, error_type string, message string")
    class Segments:
        def __init__(self) -> None:
            if not made:
                made.append(make())

        def eval(self, frame: Row) -> Iterator[tuple]:
            own = tuple(frame[c] for c in columns)
            try:
                found = [_segment(s) for s in made[0].segment(dict(zip(columns, own, strict=True)), prompts)]
            except Exception as error:  # noqa: BLE001  any failure is a failed frame
                yield (*own, None, None, type(error).__name__, str(error))
                return
            for ordinal, region in enumerate(found):
                points = [(p["x"], p["y"]) for p in region["polygon"]]
                yield (*own, ordinal, tuple(points if f == "polygon" else region[f] for f in fields), None, None)

    spark.udtf.register(name, Segments)


def proposal_id(observation: Column, url: Column, label: Column, ordinal: Column, polygon: Column) -> Column:
    """The digest of a proposal.  Python's spelling of missing values and of floats is part of the key."""
    named = [F.coalesce(c.cast("string"), F.lit("None")) for c in (observation, url, label, ordinal)]
    return F.concat(F.lit("notice-proposal-"), F.substring(F.sha2(F.concat_ws("|", *named, python_points(polygon)), 256), 1, 16))


def proposals(segments: DataFrame, model_name: str, model_version: str) -> DataFrame:
    """A row per valid region with its category, box and quality.  Ordinals count invalid regions too."""
    each = segments.where(F.col("error_type").isNull()).select("*", F.posexplode("segments").alias("ordinal", "s")).drop("segments")
    return proposals_of(each, model_name, model_version)


def proposals_of(regions: DataFrame, model_name: str, model_version: str) -> DataFrame:
    """The same from a row per region (``ordinal``, ``s``), as the table function gives them."""
    kept = regions.where(F.col("error_type").isNull() & G.valid(F.col("s.polygon")))
    return kept.select(
        "observation_id", "subject_id", "image_url", "photo_id", "species_name", "license", "frame_index",
        proposal_id(F.col("observation_id"), F.col("image_url"), F.col("s.label"), F.col("ordinal"), F.col("s.polygon")).alias("proposal_id"),
        category_id(F.col("s.label")).alias("category_id"), F.col("s.label").alias("category_label"), F.col("s.polygon").alias("polygon"),
        G.bbox(F.col("s.polygon")).alias("bbox"),
        G.quality(F.col("s.polygon"), F.col("s.detection_confidence"), F.col("s.mask_quality"), F.col("s.stability_score")).alias("quality"),
        F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"),
        F.coalesce(F.when(F.col("s.prompt") != "", F.col("s.prompt")), F.col("s.label")).alias("prompt"), F.col("s.detector_label").alias("detector_label"),
        F.lit("proposed").alias("review_state"),
    )


def failures(segments: DataFrame, model_name: str) -> DataFrame:
    return segments.where(F.col("error_type").isNotNull()).select("observation_id", "image_url", F.lit(model_name).alias("model_name"), "error_type", "message")


def ranked(found: DataFrame, top_k: int = 5, scope: str = "category") -> DataFrame:
    """All proposals with ``representative_rank`` and ``selected_for_review``."""
    scored = found.withColumn("__score", F.col("quality.representative_score"))
    marked = rank_within(scored, scope_keys(scope), "__score", "proposal_id", top_k)
    return marked.withColumnsRenamed({"rank": "representative_rank", "selected": "selected_for_review"}).drop("__score")


def annotation() -> Column:
    """A proposal in the form that applications read."""
    ring = G.ring(F.col("polygon"))
    return F.struct(
        F.col("proposal_id").alias("annotation_id"), "observation_id", "image_url", F.col("bbox.x0").alias("bbox_x0"), F.col("bbox.y0").alias("bbox_y0"),
        F.col("bbox.x1").alias("bbox_x1"), F.col("bbox.y1").alias("bbox_y1"), ring.alias("polygon"), G.geojson(F.col("polygon")).alias("geometry"),
        F.col("category_id").alias("notice_category_id"), F.col("category_label").alias("notice_category_label"),
        F.col("quality.representative_score").alias("confidence"),
        F.struct(F.col("model_name").alias("name"), F.col("model_version").alias("version"), "prompt", "detector_label").alias("model"),
        "quality", "review_state", "representative_rank", "selected_for_review", "frame_index", "subject_id",
    )


def nested_lists(parents: DataFrame, children: DataFrame, key: str, item: Column, name: str, order: Column) -> DataFrame:
    """``parents`` with the array ``name`` of their children's items, in order; empty where there are none."""
    grouped = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order.alias("__order"), item.alias("item")))).alias("__items"))
    joined = parents.join(grouped, key, "left")
    items = F.transform("__items", lambda x: x["item"])
    return joined.withColumn(name, F.coalesce(items, F.array())).drop("__items")


def batch_observations(frames: DataFrame, found: DataFrame) -> DataFrame:
    """A row per frame with its annotations; frames of one observation all get that observation's."""
    listed = nested_lists(frames, found.select("observation_id", F.col("proposal_id"), annotation().alias("annotation")), "observation_id", F.col("annotation"), "annotations", F.col("proposal_id"))
    return listed.select("observation_id", "photo_id", "image_url", "image_sha256", "local_path", "subject_id", "species_name", "license", "frame_index", "annotations")


def batch_summary(frames: DataFrame, found: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: frames, proposals, selected_for_review, failed_frames."""
    counts = [frames.agg(F.count(F.lit(1)).alias("frames")), found.agg(F.count(F.lit(1)).alias("proposals"), F.count_if("selected_for_review").alias("selected_for_review")), failed.agg(F.count(F.lit(1)).alias("failed_frames"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


def batch_head(source: str, model_name: str, model_version: str, prompts: Sequence[str], scope: str, generated_at: str) -> dict[str, Any]:
    """The fields of a batch that are the same for all of it; the time is given by the caller."""
    return {
        "schema_version": BATCH_VERSION, "generated_at": generated_at, "source": source, "model": {"name": model_name, "version": model_version},
        "prompts": list(prompts), "selection_scope": scope,
    }


def gallery(annotations: DataFrame, top_k: int, scope: str = "category", legacy: bool = False) -> DataFrame:
    """The best annotations of each group, with gallery_category_id, requires_organ_review, gallery_group and gallery_rank."""
    keys = scope_keys(scope, {"category_id": "gallery_category_id"})
    told = gallery_category(F.col("model.detector_label"), F.col("model.prompt"), F.col("notice_category_id"), legacy)
    marked = annotations.withColumn("gallery_category_id", told).withColumn("__score", F.col("quality.representative_score"))
    best = best_within(marked, keys, "__score", "annotation_id", top_k).withColumnRenamed("rank", "gallery_rank")
    return best.withColumns({
        "requires_organ_review": F.col("gallery_category_id") == "category:ambiguous_organ", "gallery_group": F.array(*keys),
    }).drop("__score")


def gallery_head(batch: dict[str, Any], top_k: int, scope: str) -> dict[str, Any]:
    return {"schema_version": GALLERY_VERSION, "source_batch_schema_version": batch["schema_version"], "source": batch["source"], "model": batch["model"], "selection_scope": scope, "top_k": top_k}


def sheet_entries(entries: DataFrame, frames: DataFrame, ordinal: str, columns: int = 3) -> DataFrame:
    """Gallery entries with the picture that each is drawn on (the last of an observation) and its place on the sheet."""
    paths = frames.groupBy("observation_id").agg(F.max_by("local_path", "frame_index").alias("local_path"))
    return entries.join(paths, "observation_id").withColumn("place", G.grid_place(F.col(ordinal), columns))


def photo_manifest(observations: DataFrame, media: DataFrame, root: str) -> DataFrame:
    """A row per observation: ``ready`` with its file's hash and size, ``missing_media`` or ``no_photo``.

    ``media``: path, image_sha256 and byte_size of the files that exist.
    """
    has = F.coalesce(F.col("photo_url"), F.lit("")) != ""
    path = joined_path(F.lit(root.rstrip("/")), F.col("observation_id"), file_name(F.col("photo_url")))
    wanted = observations.withColumn("path", F.when(has, path))
    joined = wanted.join(media.select("path", "image_sha256", "byte_size"), "path", "left")
    status = F.when(~has, "no_photo").when(F.col("byte_size").isNull(), "missing_media").otherwise("ready")
    ready = status == "ready"
    only = lambda name: F.when(ready, F.col(name))
    return joined.select(
        "observation_id", status.alias("status"), F.when(has, F.col("photo_url")).alias("image_url"), F.col("path").alias("local_path"), "image_sha256", "byte_size",
        only("latitude").alias("latitude"), only("longitude").alias("longitude"), only("time_observed_at").alias("captured_at"), only("session_id").alias("session_id"),
    )


def manifest_summary(manifest: DataFrame) -> DataFrame:
    ready = F.col("status") == "ready"
    return manifest.agg(F.count(F.lit(1)).alias("observations"), F.count_if(ready).alias("ready"), F.count_if(~ready).alias("non_ready"))


def manifest_head(instance_id: str, name: str | None, generated_at: str) -> dict[str, Any]:
    return {"schema_version": MANIFEST_VERSION, "generated_at": generated_at, "source_area": {"instance_id": instance_id, "name": name}}


def manifest_frames(manifest: DataFrame, limit: int | None = None) -> DataFrame:
    """The ready rows of a manifest as frames, numbered in the order of their ids.

    Numbers come from ranges sorted side by side: counts of each partition shift the next, so no task sorts all.
    """
    ready = manifest.where(F.col("status") == "ready")
    if limit is not None:
        ready = ready.orderBy("observation_id").limit(limit)
    numbered = numbered_by(ready, "observation_id", "frame_index")
    null = lambda name: F.lit(None).cast("string").alias(name)
    return numbered.select(
        "observation_id", "image_url", F.concat(F.lit("hypothesis:"), F.col("observation_id")).alias("subject_id"), "image_sha256", "local_path",
        null("species_name"), null("photo_id"), null("license"), "captured_at", F.col("frame_index").cast("int").alias("frame_index"),
    )
