"""Column functions on values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sylvatica.functions import answers as A
from sylvatica.functions import geometry as G
from sylvatica.functions import payloads as P
from sylvatica.functions import text as X


def value(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean"}
    given = {k: F.lit(v).cast(kinds[type(v)]) if v is not None else F.lit(None).cast("string") for k, v in values.items()}
    return spark.range(1).withColumns(given).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("said", "read"), [
    ("Yes.", "YES"), ("NOT SURE", "NO"), ("inconclusive", "INCONCLUSIVE"), ("It is known", "NO"), ("", "INCONCLUSIVE"), ("oh yes", "YES"), ("purple", "INCONCLUSIVE"), (" yes", "YES"), ("Zinc, yes", "INCONCLUSIVE"),
])
def test_parse_yes_no(spark, said, read):
    assert value(spark, A.parse_yes_no(F.col("a")), a=said) == read


@pytest.mark.parametrize(("said", "read"), [
    ("a", "A"), ("It has 3 regular parts", "A"), ("2", "3 Regular Parts"), ("3", "INCONCLUSIVE"), ("", "INCONCLUSIVE"), ("0", "INCONCLUSIVE"), ("9", "INCONCLUSIVE"), ("99999999999999", "INCONCLUSIVE"),
    ("\t3 REGULAR PARTS\n", "3 Regular Parts"),
])
def test_parse_choice(spark, said, read):
    assert value(spark, A.parse_choice(F.col("a"), F.array(F.lit("A"), F.lit("3 Regular Parts"))), a=said) == read


def test_parse_choice_cannot_determine_comes_after_substrings(spark):
    values = F.array(F.lit("Determine"), F.lit("xyz"))
    assert value(spark, A.parse_choice(F.col("a"), values), a="I cannot determine it") == "Determine"
    assert value(spark, A.parse_choice(F.col("a"), F.array(F.lit("xyz"))), a="1 cannot determine") == "INCONCLUSIVE"


@pytest.mark.parametrize(("label", "organ"), [("fruit bud", "ambiguous organ"), ("a Leaf_blade", "leaf"), ("whole__plant", "whole plant"), ("root", "ambiguous organ"), ("", "ambiguous organ"), ("BRANCH", "branch")])
def test_organ_label(spark, label, organ):
    assert value(spark, X.organ_label(F.col("a")), a=label) == organ


def test_categories(spark):
    assert value(spark, X.category_id(F.col("a")), a=" Whole Plant") == "category:plant"
    assert value(spark, X.category_id(F.col("a")), a="branch") == "category:stem"
    modern = X.gallery_category(F.col("a"), F.col("b"), F.lit("category:x"))
    legacy = X.gallery_category(F.col("a"), F.col("b"), F.lit("category:x"), legacy=True)
    assert value(spark, modern, a="fruit bud", b="leaf") == "category:ambiguous_organ"
    assert value(spark, legacy, a="fruit bud", b="leaf") == "category:ambiguous organ"
    assert value(spark, legacy, a="", b="whole plant") == "category:whole plant"
    assert value(spark, modern, a="", b="") == "category:x"


@pytest.mark.parametrize(("text", "slug"), [("a b/c", "a-b-c"), ("--x--", "x"), ("", "none"), ("!!!", "none"), ("y" * 130, "y" * 120), ("é.é_1", ".-_1")])
def test_slug(spark, text, slug):
    assert value(spark, X.slug(F.col("a")), a=text) == slug


def test_lists_and_settings(spark):
    assert value(spark, X.split_list(F.col("a")), a=" a, ,b\t,, c") == ["a", "b", "c"]
    for line, expected in [("A=1", ("A", "1")), ("export B = 'x y' ", ("B", "x y")), ('C="', ("C", '"')), ("# D=1", None), ("nothing", None), ("=1", None), ("E=a=b", ("E", "a=b")), ("F=", ("F", ""))]:
        found = value(spark, X.setting(F.col("a")), a=line)
        assert (tuple(found) if found else None) == expected, line
    assert value(spark, X.first_filled(F.col("a"), F.col("b")), a="  ", b="x") == ""
    assert value(spark, X.first_filled(F.col("a"), F.col("b")), a="", b=" x\xa0") == "x"
    assert value(spark, X.whole_or_text(F.col("a"))[0], a=" 12 ") == 12
    assert value(spark, X.whole_or_text(F.col("a"))[1], a="all") == "all"


POLYGONS = {
    "leaf": [(0.2, 0.2), (0.8, 0.2), (0.75, 0.75), (0.25, 0.8)],
    "flower": [(0.0, 0.0), (0.01, 0.0), (0.01, 0.01)],
    "outside": [(0.0, 0.0), (1.5, 0.0), (0.1, 0.1)],
    "line": [(0.0, 0.0), (0.1, 0.1)],
}


def test_quality_goldens(spark):
    rows = [("leaf", POLYGONS["leaf"], 0.95, 0.95, 0.9), ("leaf2", POLYGONS["leaf"], 0.55, 0.55, 0.9), ("flower", POLYGONS["flower"], 0.2, 0.3, 0.5)]
    df = spark.createDataFrame(rows, "name string, p array<struct<x:double,y:double>>, d double, m double, s double")
    found = {r.name: r.q for r in df.select("name", G.quality(F.col("p"), F.col("d"), F.col("m"), F.col("s")).alias("q")).collect()}
    assert (found["leaf"].area_fraction, found["leaf"].area_score, found["leaf"].border_score, found["leaf"].representative_score) == (0.31625, 1.0, 1.0, 0.955)
    assert found["leaf2"].representative_score == 0.715
    assert found["leaf"].flags == []
    assert (found["flower"].area_fraction, found["flower"].area_score, found["flower"].border_score, found["flower"].representative_score) == (0.00005, 0.0025, 0.0, 0.225375)
    assert found["flower"].flags == ["small_region", "touches_frame_edge", "low_detection_confidence", "low_mask_quality"]


def test_polygons(spark):
    df = spark.createDataFrame(list(POLYGONS.items()), "name string, p array<struct<x:double,y:double>>")
    found = {r.name: r for r in df.select("name", G.valid(F.col("p")).alias("valid"), G.ring(F.col("p")).alias("ring")).collect()}
    assert {n: r.valid for n, r in found.items()} == {"leaf": True, "flower": True, "outside": False, "line": False}
    assert found["leaf"].ring[0] == found["leaf"].ring[-1] and len(found["leaf"].ring) == 5
    closed = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)],)], "p array<struct<x:double,y:double>>")
    assert len(closed.select(G.ring(F.col("p")).alias("r")).first().r) == 3
    assert value(spark, G.clamp(F.col("a")), a=float("nan")) == 1.0


def test_payloads(spark):
    assert bytes(value(spark, P.decode_image(F.col("a")), a="data:image/png;base64,aGk=")) == b"hi"
    assert value(spark, P.decode_image(F.col("a")), a="%%%") is None
    assert value(spark, P.data_url(F.col("a"), F.lit("hi").cast("binary")), a="x/y.JPG") == "data:image/jpeg;base64,aGk="
    assert value(spark, P.media_type(F.col("a")), a="noending") == "image/png"
    for price, zero in [("0", True), ("0.00", True), ("", False), ("free", False), (None, False), ("-0", True), ("1e-9", False)]:
        assert value(spark, P.is_zero_price(F.col("a")), a=price) is zero
    assert value(spark, P.answer_content(F.col("a")), a='{"choices":[{"message":{"content":" hi "}}]}') == "hi"
    assert value(spark, P.answer_content(F.col("a")), a='{"choices":[{"message":{"content":[{"type":"text","text":"a"},"b"]}}]}') == "a\nb"


def test_prompts(spark):
    leafless = A.existence_prompt(F.lit("key_leaf_type"), F.lit("u"), F.lit("No Apparent leaves"))
    parts = spark.range(1).select(leafless.alias("p")).first().p
    assert parts[0] == ("image", "u") and parts[1].value.endswith("answer YES.") and "'leaf type'" in parts[1].value
    options = F.array(F.struct(F.lit("A").alias("value"), F.lit("d").alias("description"), F.lit(None).cast("string").alias("photo"), F.lit("i.png").alias("illustration")))
    parts = spark.range(1).select(A.choice_prompt(F.lit("other"), options, F.lit("u")).alias("p")).first().p
    assert [p.value for p in parts][2:] == ["\n1. **A** — d", "Botanical illustration for option 1:", "i.png", "\n2. **Cannot determine from this image**", '\nRespond with ONLY the exact option text (e.g., "A") or "Cannot determine from this image".']
    assert spark.range(1).select(A.mock_answer(A.choice_prompt(F.lit("other"), options, F.lit("u"))).alias("v")).first().v == "Cannot determine from this image"
    assert spark.range(1).select(A.mock_answer(leafless).alias("v")).first().v == "INCONCLUSIVE"
