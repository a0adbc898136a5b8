"""From masks to polygons: the largest region's outline, simplified, in a frame of 1 x 1.

A mask is a column of bytes (one per pixel, row by row, not 0 inside) with its width and height.  The outline
is traced pixel by pixel around the largest region (joined by edges or corners) and thinned so that no point
left out lies farther from it than ``epsilon`` times its length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

EPSILON = 0.003
POINTS = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
#: Neighbours in clockwise order from the left, as (row, column) steps.
_AROUND = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def regions(mask: np.ndarray) -> list[np.ndarray]:
    """The pixels of each region, as (row, column) rows, by joining runs of neighbouring rows."""
    parent: list[int] = []
    runs: list[tuple[int, int, int]] = []
    before: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        now = []
        for start, stop in zip(edge[::2], edge[1::2], strict=True):
            parent.append(len(parent))
            runs.append((y, int(start), int(stop)))
            now.append(len(runs) - 1)
            for k in before:
                if runs[k][1] <= stop and start <= runs[k][2]:
                    parent[root(k)] = root(now[-1])
        before = now
    groups: dict[int, list[int]] = {}
    for k in range(len(runs)):
        groups.setdefault(root(k), []).append(k)
    return [np.concatenate([np.stack([np.full(b - a, y), np.arange(a, b)], axis=1) for y, a, b in (runs[k] for k in ks)]) for ks in groups.values()]


def outline(pixels: np.ndarray) -> list[tuple[int, int]]:
    """The border pixels of a region, clockwise from its first one, as (x, y).

    The walk keeps the outside on its left and ends when it is about to leave its first pixel as it did at
    first: a narrow region is passed twice, and a pixel where parts meet does not end the walk.
    """
    inside = set(map(tuple, pixels.tolist()))
    at = start = min(inside)
    path, came, first = [start], 0, None
    while True:
        way = next((w % 8 for w in range(came + 1, came + 9) if (at[0] + _AROUND[w % 8][0], at[1] + _AROUND[w % 8][1]) in inside), None)
        if way is None or (at == start and way == first):
            break
        if first is None:
            first = way
        at = (at[0] + _AROUND[way][0], at[1] + _AROUND[way][1])
        came = (way + 4) % 8
        path.append(at)
    if len(path) > 1:
        path.pop()  # the first pixel again
    return [(x, y) for y, x in path]


def simplified(points: list[tuple[int, int]], tolerance: float) -> list[tuple[int, int]]:
    """The points of a closed outline that are needed to stay within ``tolerance`` of all."""
    if len(points) < 4:
        return points
    p = np.array(points, float)
    far = int(np.argmax(((p - p[0]) ** 2).sum(axis=1)))
    keep = np.zeros(len(p), bool)
    keep[[0, far]] = True
    stack = [(0, far), (far, len(p))]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        first, last = p[a], p[b % len(p)]
        line = last - first
        rest = p[a + 1 : b] - first
        length = np.hypot(*line)
        distance = np.abs(line[0] * rest[:, 1] - line[1] * rest[:, 0]) / length if length else np.hypot(rest[:, 0], rest[:, 1])
        top = int(np.argmax(distance))
        if distance[top] > tolerance:
            keep[a + 1 + top] = True
            stack += [(a, a + 1 + top), (a + 1 + top, b)]
    return [q for q, k in zip(points, keep, strict=True) if k]


def mask_polygon(mask: np.ndarray, epsilon: float = EPSILON) -> list[dict[str, float]]:
    """The largest region's outline as points in 0..1; [] for an empty mask or a region of less than three points."""
    found = regions(mask != 0)
    if not found:
        return []
    path = outline(max(found, key=len))
    closed = np.array([*path, path[0]], float)
    around = float(np.hypot(*np.diff(closed, axis=0).T).sum())
    kept = simplified(path, epsilon * around)
    height, width = mask.shape
    return [{"x": x / width, "y": y / height} for x, y in kept] if len(kept) >= 3 else []


def polygon(mask: Column, width: Column, height: Column, epsilon: float = EPSILON) -> Column:
    """The polygon of a mask column; null for a null mask or one whose bytes do not fill its frame."""

    @F.pandas_udf(POINTS)
    def trace(masks: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
        out = []
        for raw, w, h in zip(masks, widths, heights, strict=True):
            fits = raw is not None and w and h and len(raw) == w * h
            out.append(mask_polygon(np.frombuffer(raw, np.uint8).reshape(int(h), int(w)), epsilon) if fits else None)
        return pd.Series(out, dtype=object)

    return trace(mask, width, height)
