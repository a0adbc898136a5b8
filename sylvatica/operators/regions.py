"""Regions of masks as rows: runs of pixels, the regions that touching runs make, and the largest of each mask.

A mask is an array of booleans, row by row, with its width.  Nothing runs in Python: runs are cut out of each array in
place, runs of neighbouring rows that touch by edges or corners are edges of a graph, and its components are labelled by
hooking and pointer jumping, whose rounds grow with the logarithm of a region's runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvatica.session import settled

#: Rounds after which labelling must be over: each at least halves the roots of a region that is not one yet.
ROUNDS = 64


def run_list(cells: Column, width: Column) -> Column:
    """The runs of a mask in order, as struct(y, first, last)."""
    inside = lambda i: F.coalesce(F.get(cells, i), F.lit(False))
    every = F.when(F.size(cells) > 0, F.sequence(F.lit(0), F.size(cells) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(every, lambda i: inside(i) & ((i % width == 0) | ~inside(i - 1)))
    stops = F.filter(every, lambda i: inside(i) & ((i % width == width - 1) | ~inside(i + 1)))
    return F.zip_with(starts, stops, lambda a, b: F.struct(F.floor(a / width).cast("int").alias("y"), (a % width).cast("int").alias("first"), (b % width).cast("int").alias("last")))


def runs(masks: DataFrame, mask: str = "mask_id", cells: str = "cells", width: str = "width") -> DataFrame:
    """mask, run (its number in the mask), y, first, last.  A mask that is null, empty or all outside has none."""
    listed = masks.where(F.col(cells).isNotNull() & (F.col(width) > 0)).select(F.col(mask).alias("mask"), F.posexplode(run_list(F.col(cells), F.col(width))).alias("run", "r"))
    return listed.select("mask", "run", "r.y", "r.first", "r.last")


def touching(cut: DataFrame) -> DataFrame:
    """(mask, a, b), both ways, for runs of neighbouring rows that touch.  A row of a mask is met by the next one only."""
    above = cut.select("mask", (F.col("y") + 1).alias("y"), F.col("run").alias("a"), F.col("first").alias("a_first"), F.col("last").alias("a_last"))
    below = cut.select("mask", "y", F.col("run").alias("b"), F.col("first").alias("b_first"), F.col("last").alias("b_last"))
    met = above.join(below, ["mask", "y"]).where("a_first <= b_last + 1 AND b_first <= a_last + 1").select("mask", "a", "b")
    return met.unionByName(met.select("mask", F.col("b").alias("a"), F.col("a").alias("b")))


def labelled(cut: DataFrame) -> DataFrame:
    """``cut`` with ``region``, the number of the first run of each run's region."""
    edges = settled(touching(cut))
    state = settled(cut.withColumn("region", F.col("run")))
    for _ in range(ROUNDS):
        label = state.select("mask", F.col("run").alias("b"), F.col("region").alias("other"))
        own = state.select("mask", F.col("run").alias("a"), "region")
        # the least label that any run of a region touches is the region's new root
        hooks = settled(edges.join(label, ["mask", "b"]).join(own, ["mask", "a"]).where("other < region").groupBy("mask", "region").agg(F.min("other").alias("root")))
        if hooks.isEmpty():
            return state
        jump = hooks.select("mask", F.col("region").alias("root"), F.col("root").alias("further"))
        for _ in range(2):  # roots that hook on are passed over, twice a round
            hooks = hooks.join(jump, ["mask", "root"], "left").select("mask", "region", F.coalesce("further", "root").alias("root"))
            jump = hooks.select("mask", F.col("region").alias("root"), F.col("root").alias("further"))
        state = settled(state.join(hooks, ["mask", "region"], "left").withColumn("region", F.coalesce("root", "region")).select(*cut.columns, "region"))
    raise RuntimeError(f"regions are not one after {ROUNDS} rounds")


def region_figures(marked: DataFrame) -> DataFrame:
    """mask, region, area and box (in pixels, ends included) of every region."""
    return marked.groupBy("mask", "region").agg(
        F.sum(F.col("last") - F.col("first") + 1).cast("long").alias("area"), F.min("first").alias("x0"), F.min("y").alias("y0"), F.max("last").alias("x1"), F.max("y").alias("y1"),
    )


def largest(figures: DataFrame) -> DataFrame:
    """The largest region of each mask, of equal ones the first, and how many it has."""
    order = F.struct("area", -F.col("region"))
    best = figures.groupBy("mask").agg(F.max_by(F.struct("region", "area", "x0", "y0", "x1", "y1"), order).alias("r"), F.count(F.lit(1)).alias("regions"))
    return best.select("mask", "r.*", "regions")
