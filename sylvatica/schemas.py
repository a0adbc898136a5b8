"""Row types and domains shared by the operators."""

from __future__ import annotations

#: Ranks from the widest to the narrowest.
TAXON_RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")
NODE_KINDS = ("taxon", "notice", "feature")
EVIDENCE_STATES = ("confirmed", "rejected", "unknown")
OUTCOMES = ("classified", "abstained", "invalid")

POINT = "struct<x: double, y: double>"
POLYGON = f"array<{POINT}>"

FRAME = (
    "observation_id string, image_url string, subject_id string, image_sha256 string, local_path string, species_name string, "
    "photo_id string, license string, captured_at string, frame_index int"
)
SEGMENT = f"struct<label: string, polygon: {POLYGON}, detection_confidence: double, mask_quality: double, stability_score: double, prompt: string, detector_label: string>"
NODE = "node_id string, label string, kind string, parent_id string, taxon_rank string, source_feature_id string"
EVIDENCE = "ordinal long, node_id string, state string, notice_proposal_id string, annotation_id string"
FEATURE_EVIDENCE = (
    "case_id string, release_id string, feature_id string, value_id string, notice_proposal_id string, annotation_id string, "
    "confidence double, review_state string"
)
OBSERVATION_CSV = (
    "id string, observation_id string, image_url string, scientific_name string, species_guess string, photo_id string, license string, observed_on string"
)
STEP_RESULT = (
    "trial_id string, run_started_at string, model_mode string, model string, sample_limit string, features_requested string, observation_id string, "
    "photo_id string, photo_url string, taxon_id string, species_inat string, guide_species_name string, feature string, true_value string, "
    "p1_prompt_parts_json string, p1_raw string, p1_parsed string, p1_parse_rule string, p2_prompt_parts_json string, p2_raw string, p2_parsed string, "
    "p2_parse_rule string, feature_correct boolean, committed boolean"
)

#: The versions that documents carry.
BATCH_VERSION = "arq.notice-proposal-batch/v1"
GALLERY_VERSION = "arq.notice-review-gallery/v1"
MANIFEST_VERSION = "arq.local-photo-manifest/v1"

#: The lists of a release document, by what they hold.
RELEASE_TABLES = {
    "registry": "devo_registry",
    "features": "devo_features",
    "feature_values": "devo_feature_values",
    "images": "devo_images",
    "annotations": "devo_annotations",
    "taxa": "devo_taxa",
    "claims": "devo_taxon_feature_value",
}
RELEASE_NAME = "devo_name"
RELEASE_ROW = {
    "registry": f"{RELEASE_NAME} string",
    "features": f"{RELEASE_NAME} string, feature_name string",
    "feature_values": f"{RELEASE_NAME} string, vocab_id string, feature_name string, source_value_id string",
    "images": "image_id string",
    "annotations": "annotation_id string",
    "taxa": f"{RELEASE_NAME} string, taxon_name string, source_taxon_id string",
    "claims": f"{RELEASE_NAME} string, taxon_name string, feature_name string, vocab_id string, assertion_source string, source_context_id string",
}
