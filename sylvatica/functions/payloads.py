"""Model messages and catalogue entries: JSON, base64 and prices as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvatica.functions.text import strip

#: File endings and their media types; anything else counts as image/png.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff"}
#: Words that mark a model as unfit for questions.
UNFIT_MODELS = ("safety", "moderation", "guardrail", "filter", "embedding")


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def decode_image(data: Column) -> Column:
    """The bytes of base64 text, with or without the head of a data URL; null if it is no base64."""
    return F.try_to_binary(F.element_at(F.split(data, ",", 2), -1), F.lit("base64"))


def media_type(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.substring_index(name, ".", -1))), F.lit("image/png"))


def data_url(name: Column, content: Column) -> Column:
    # base64 of more than 57 bytes has line ends, which a URL must not
    return F.concat(F.lit("data:"), media_type(name), F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def is_remote(reference: Column) -> Column:
    return reference.rlike(r"^(?:https?://|data:)")


def has_image(parts: Column) -> Column:
    return F.exists(parts, lambda p: p["kind"] == "image")


def chat_content(parts: Column) -> Column:
    """Prompt parts as a chat message's content: a JSON array of text and image entries."""
    as_json = F.transform(
        parts,
        lambda p: F.when(p["kind"] == "image", F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(p["value"].alias("url")).alias("image_url"))))
        .otherwise(F.to_json(F.struct(F.lit("text").alias("type"), p["value"].alias("text")))),
    )
    return F.concat(F.lit("["), F.array_join(as_json, ","), F.lit("]"))


def parts_json(parts: Column) -> Column:
    """Prompt parts as JSON text: a string for text, an object for an image."""
    as_json = F.transform(parts, lambda p: F.when(p["kind"] == "image", F.to_json(F.struct(p["value"].alias("image")))).otherwise(json_string(p["value"])))
    return F.concat(F.lit("["), F.array_join(as_json, ", "), F.lit("]"))


def json_string(value: Column) -> Column:
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def answer_content(response: Column) -> Column:
    """The text of a chat response: a string, or the texts in a list, a line each."""
    content = F.get_json_object(response, "$.choices[0].message.content")
    items = F.from_json(content, "array<string>")
    texts = F.array_compact(F.transform(items, lambda i: F.when(i.startswith("{"), F.get_json_object(i, "$.text")).otherwise(i)))
    listed = F.coalesce(content.startswith("["), F.lit(False)) & items.isNotNull()
    return strip(F.when(listed, F.array_join(texts, "\n")).otherwise(content))


def is_zero_price(value: Column) -> Column:
    return F.coalesce(value.cast("string").try_cast("double") == 0.0, F.lit(False))


def usable_free_model(model: Column, require_image: bool) -> Column:
    """Whether a catalogue entry (id, name, pricing, architecture) is free and answers text, by image if asked."""
    name = F.lower(F.concat_ws(" ", F.coalesce(model["id"], F.lit("")), F.coalesce(model["name"], F.lit(""))))
    fit = ~name.rlike("|".join(UNFIT_MODELS))
    free = is_zero_price(model["pricing"]["prompt"]) & is_zero_price(model["pricing"]["completion"])
    takes, gives = model["architecture"]["input_modalities"], model["architecture"]["output_modalities"]
    has = lambda which, kind: F.coalesce(F.array_contains(which, kind), F.lit(False))
    able = has(takes, "text") & has(gives, "text")
    return fit & free & (able & has(takes, "image") if require_image else able)
