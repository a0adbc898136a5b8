"""Polygons as arrays of (x, y) structs in a frame of 1 x 1: size, place and quality of a region."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvatica.functions.floats import half_even

#: Weights of the representative score and bounds of its parts.
WEIGHTS = {"detection": 0.30, "mask": 0.30, "stability": 0.15, "area": 0.15, "border": 0.10}
AREA_PREFERRED = (0.02, 0.65)
BORDER_FULL = 0.04
SMALL_AREA, LARGE_AREA, EDGE, LOW_DETECTION, LOW_MASK = 0.01, 0.75, 0.005, 0.3, 0.5
DIGITS = 6


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def valid(polygon: Column) -> Column:
    """Three points or more, all inside the frame."""
    inside = F.forall(polygon, lambda p: p["x"].between(0, 1) & p["y"].between(0, 1))
    return F.coalesce((F.size(polygon) >= 3) & inside, F.lit(False))


def bbox(polygon: Column) -> Column:
    x, y = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def area(polygon: Column) -> Column:
    """Half the absolute sum of the cross products of neighbouring points."""
    after = F.concat(F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    cross = F.zip_with(polygon, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda total, c: total + c)) / 2


def area_score(size: Column) -> Column:
    least, most = AREA_PREFERRED
    return F.when(size < least, clamp(size / least)).when(size > most, clamp((1 - size) / (1 - most))).otherwise(F.lit(1.0))


def border_distance(box: Column) -> Column:
    return F.least(box["x0"], box["y0"], 1 - box["x1"], 1 - box["y1"])


def quality_flags(size: Column, border: Column, detection: Column, mask: Column) -> Column:
    tests = [
        ("small_region", size < SMALL_AREA), ("dominates_frame", size > LARGE_AREA), ("touches_frame_edge", border <= EDGE),
        ("low_detection_confidence", detection < LOW_DETECTION), ("low_mask_quality", mask < LOW_MASK),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def quality(polygon: Column, detection: Column, mask: Column, stability: Column) -> Column:
    """The region's figures and its representative score, rounded by their exact binary values, halves to even."""
    size, border = area(polygon), border_distance(bbox(polygon))
    border_part, area_part = clamp(border / BORDER_FULL), area_score(size)
    w = WEIGHTS
    score = w["detection"] * clamp(detection) + w["mask"] * clamp(mask) + w["stability"] * clamp(stability) + w["area"] * area_part + w["border"] * border_part
    return F.struct(
        half_even(score, DIGITS).alias("representative_score"), clamp(detection).alias("detection_confidence"), clamp(mask).alias("mask_quality"),
        clamp(stability).alias("stability_score"), half_even(area_part, DIGITS).alias("area_score"), half_even(border_part, DIGITS).alias("border_score"),
        half_even(size, DIGITS).alias("area_fraction"), quality_flags(size, border, detection, mask).alias("flags"),
    )


def gate_confidence(detection: Column, mask: Column) -> Column:
    return half_even(0.5 * detection + 0.5 * mask, DIGITS)


def ring(polygon: Column) -> Column:
    """The polygon as [x, y] pairs, closed by its first point."""
    pairs = F.transform(polygon, lambda p: F.array(p["x"], p["y"]))
    first, last = F.get(pairs, F.lit(0)), F.try_element_at(pairs, F.lit(-1))
    return F.when((F.size(pairs) > 0) & (first != last), F.concat(pairs, F.array(first))).otherwise(pairs)


def geojson(polygon: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring(polygon)).alias("coordinates"))


def scale(polygon: Column, width: Column, height: Column, right: Column | float = 0.0) -> Column:
    """In pixels of a picture of that size that begins ``right`` pixels from the left."""
    return F.transform(polygon, lambda p: F.struct((p["x"] * width + right).alias("x"), (p["y"] * height).alias("y")))


def grid_place(ordinal: Column, columns: int = 3) -> Column:
    """struct(column, row) of the n-th picture of a sheet."""
    return F.struct((ordinal % columns).cast("int").alias("column"), F.floor(ordinal / columns).cast("int").alias("row"))
