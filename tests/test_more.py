"""Settings, catalogues and masks."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvatica import settings
from sylvatica.functions import geometry, masks
from sylvatica.operators import gate
from sylvatica.sources import catalogues


def test_settings():
    made = settings.TrialSettings.from_environment({"EXPERIMENT_MODELS": " a, ,b", "EXPERIMENT_SAMPLE_LIMIT": "0", "EXPERIMENT_WORKERS": " ", "OTHER": "x"})
    assert (made.models, made.limit, made.workers, made.mode) == (["a", "b"], 0, 3, "mock")
    assert settings.TrialSettings.from_environment({}).limit is None
    with pytest.raises(ValueError):
        settings.TrialSettings.from_environment({"EXPERIMENT_MODEL_MODE": "other"})
    assert settings.whole_or_text("7") == 7 and settings.whole_or_text("all") == "all"
    assert settings.command_text(["run"], ["a b", "c"]) == "run 'a b' c" and settings.command_text(["run"], []) == "run"
    assert settings.same_key(None, None) and settings.same_key("k", "k") and not settings.same_key(None, "k")


def test_catalogue(spark):
    vision = {"id": "v", "name": "V", "pricing": {"prompt": "0", "completion": 0}, "architecture": {"input_modalities": ["text", "image"], "output_modalities": ["text"]}}
    plain = vision | {"id": "p", "architecture": {"input_modalities": ["text"], "output_modalities": ["text"]}}
    unfit = vision | {"id": "x", "name": "Content Filter"}
    table = catalogues.model_catalogue(spark, lambda: json.dumps({"data": [unfit, plain, vision, {"id": "bare"}]}))
    asked = spark.createDataFrame([("openrouter/free",), (" own/model ",)], "model string")
    found = lambda **o: {r.model: r.resolved for r in gate.resolve_models(asked, table, **o).collect()}
    assert found() == {"openrouter/free": "p", " own/model ": "own/model"}
    assert found(require_image=True)["openrouter/free"] == "v"
    assert found(override=" mine ")["openrouter/free"] == "mine"
    assert {r.resolved for r in gate.resolve_models(asked.limit(1), table.where("ordinal = 0")).collect()} == {None}


def test_mask_of_a_rectangle_and_a_speck():
    mask = np.zeros((40, 60), np.uint8)
    mask[10:30, 15:45] = 1
    mask[2, 2] = 1
    corners = {(round(p["x"] * 60), round(p["y"] * 40)) for p in masks.mask_polygon(mask)}
    assert corners == {(15, 10), (44, 10), (44, 29), (15, 29)}
    assert masks.mask_polygon(np.zeros((5, 5), np.uint8)) == []
    one = np.zeros((5, 5), np.uint8)
    one[2, 2] = 1
    assert masks.mask_polygon(one) == []


def test_an_outline_passes_a_pinch_twice():
    mask = np.zeros((7, 13), np.uint8)
    mask[1:6, 1:6] = mask[1:6, 7:12] = 1
    mask[3, 6] = 1
    path = masks.outline(np.argwhere(mask))
    assert path.count((6, 3)) == 2 and {x for x, _ in path} >= {1, 5, 7, 11}
    line = masks.outline(np.argwhere(np.ones((1, 4), np.uint8)))
    assert line == [(0, 0), (1, 0), (2, 0), (3, 0), (2, 0), (1, 0)]


@pytest.mark.parametrize("seed", range(4))
def test_outlines_enclose_about_the_region(seed):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:80, 0:80]
    mask = (((x - 40) / rng.uniform(15, 35)) ** 2 + ((y - 40) / rng.uniform(15, 35)) ** 2 < 1).astype(np.uint8)
    points = masks.mask_polygon(mask)
    px, py = np.array([p["x"] for p in points]) * 80, np.array([p["y"] for p in points]) * 80
    size = abs((px * np.roll(py, -1) - np.roll(px, -1) * py).sum()) / 2
    assert abs(size - mask.sum()) < 0.12 * mask.sum() and len(points) < 60


def test_mask_column(spark):
    mask = np.zeros((8, 8), np.uint8)
    mask[1:7, 1:7] = 1
    rows = [(bytearray(mask.tobytes()), 8, 8), (None, 8, 8), (bytearray(b"xx"), 8, 8)]
    made = spark.createDataFrame(rows, "m binary, w int, h int").select(masks.polygon(F.col("m"), F.col("w"), F.col("h")).alias("p")).select("p", geometry.valid(F.col("p")).alias("v")).collect()
    assert [len(r.p) if r.p is not None else None for r in made] == [4, None, None]
    assert [r.v for r in made] == [True, False, False]
