"""Polygons, distances and overlaps on annotation tables.

Coordinates are ARRAY<STRUCT<x, y>> columns. Spatial joins go through a grid: both sides emit the cells they touch and
meet by equi-join, so nothing is compared across a whole slide.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagframe.functions import scalars as S
from bagframe.operators.boxes import merge_boxes  # noqa: F401  (part of the geometry operators)
from bagframe.operators.overlap import intersecting


def _next_points(coords: Column) -> Column:
    """The coordinates rotated by one, so zip pairs every vertex with its successor."""
    return F.concat(F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0))), F.slice(coords, 1, 1))


def _cross_sums(coords: Column) -> Column:
    """Struct of sums over edges: a = cross product, cx, cy = cross-weighted vertex sums."""
    edges = F.arrays_zip(coords.alias("p"), _next_points(coords).alias("q"))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))

    def step(acc: Column, e: Column) -> Column:
        px, py, qx, qy = (e[s][v].cast("double") for s in ("p", "q") for v in ("x", "y"))
        cross = px * qy - qx * py
        return F.struct((acc["a"] + cross).alias("a"), (acc["cx"] + (px + qx) * cross).alias("cx"),
                        (acc["cy"] + (py + qy) * cross).alias("cy"))

    return F.aggregate(edges, zero, step)


def polygon_area(coords: str | Column) -> Column:
    """Shoelace area in square pixels."""
    c = F.col(coords) if isinstance(coords, str) else coords
    return F.abs(_cross_sums(c)["a"]) / 2.0


def area_mm2(coords: str | Column, spacing: Column | float) -> Column:
    return S.px_to_mm2(polygon_area(coords), spacing)


def centroid(coords: str | Column) -> Column:
    """Area centroid; the mean of the vertices for a degenerate polygon."""
    c = F.col(coords) if isinstance(coords, str) else coords
    s = _cross_sums(c)
    n = F.size(c)

    def mean(v: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, p: a + p[v].cast("double")) / n

    return F.struct(F.coalesce(F.try_divide(s["cx"], 3 * s["a"]), mean("x")).alias("x"),
                    F.coalesce(F.try_divide(s["cy"], 3 * s["a"]), mean("y")).alias("y"))


def bounds(coords: str | Column) -> Column:
    """Struct x0, y0, x1, y1."""
    c = F.col(coords) if isinstance(coords, str) else coords
    xs, ys = F.transform(c, lambda p: p["x"].cast("double")), F.transform(c, lambda p: p["y"].cast("double"))
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _cells(b: str, cell: float, margin: float = 0.0) -> tuple[Column, Column]:
    c = F.col(b)

    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor((c[lo] - margin) / cell), F.floor((c[hi] + margin) / cell))

    return span("x0", "x1"), span("y0", "y1")


def in_cells(df: DataFrame, box: str, cell: float, margin: float = 0.0) -> DataFrame:
    """One row per grid cell the box (struct x0, y0, x1, y1) touches."""
    xs, ys = _cells(box, cell, margin)
    return df.withColumn("cell_x", F.explode(xs)).withColumn("cell_y", F.explode(ys))


def _points(coords) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in coords], dtype=float).reshape(-1, 2)


def _inside(p: np.ndarray, poly: np.ndarray) -> np.ndarray:
    """Points strictly inside by ray casting."""
    a, b = poly, np.roll(poly, -1, axis=0)
    px, py = p[:, None, 0], p[:, None, 1]
    crosses = (a[None, :, 1] > py) != (b[None, :, 1] > py)
    dy = np.where(b[:, 1] == a[:, 1], 1.0, b[:, 1] - a[:, 1])
    at = (b[:, 0] - a[:, 0]) * (py - a[:, 1]) / dy + a[:, 0]
    return (crosses & (px < at)).sum(1) % 2 == 1


def _on_border(p: np.ndarray, poly: np.ndarray) -> bool:
    a, b = poly, np.roll(poly, -1, axis=0)
    cross = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[0] - a[:, 0])
    within = ((np.minimum(a, b) <= p) & (p <= np.maximum(a, b))).all(axis=1)
    return bool(((cross == 0) & within).any())


def _edges_meet(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether any edge of p touches any edge of q (collinear contact included)."""
    def side(a, b, c):
        return np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))

    a, b = p[:, None], np.roll(p, -1, axis=0)[:, None]
    c, d = q[None], np.roll(q, -1, axis=0)[None]
    apart = (side(a, b, c) * side(a, b, d) > 0) | (side(c, d, a) * side(c, d, b) > 0)
    lo1, hi1, lo2, hi2 = np.minimum(a, b), np.maximum(a, b), np.minimum(c, d), np.maximum(c, d)
    boxes = ((lo1 <= hi2) & (lo2 <= hi1)).all(axis=-1)
    return bool((~apart & boxes).any())


def shapes_intersect(region: np.ndarray, other: np.ndarray) -> bool:
    """A point must lie strictly inside the region; other shapes must share at least one point with it."""
    if len(other) == 1:
        return bool(_inside(other, region)[0]) and not _on_border(other[0], region)
    return _edges_meet(region, other) or bool(_inside(other[:1], region)[0]) or bool(_inside(region[:1], other)[0])


def overlapping(annos: DataFrame, regions: DataFrame, cell: float = 1024.0, file: str = "file") -> DataFrame:
    """(file, region, name, ...) for annotations that intersect a region polygon of the same file, as :func:`shapes_intersect` tells for
    one pair; see :func:`bagframe.operators.overlap.intersecting`."""
    return intersecting(annos, regions, cell, file)


def contour_distances(contours: DataFrame, within: float, file: str = "file", name: str = "name") -> DataFrame:
    """(file, a, b, distance): smallest vertex distance of every pair of contours of a file that are at most
    ``within`` apart.

    Vertices meet through a grid of cell size ``within``: one side emits its own cell, the other its 3 x 3
    neighbourhood, so only near vertices are compared. The full matrix of far pairs is never formed.
    """
    v = contours.select(F.col(file).alias("file"), F.col(name).alias("c"), F.explode("coords").alias("p")).select(
        "file", "c", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y")).distinct()
    own = v.withColumns({"cx": F.floor(F.col("x") / within), "cy": F.floor(F.col("y") / within)})
    near = F.sequence(F.lit(-1), F.lit(1))
    wide = own.select("file", F.col("c").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"),
                      F.explode(F.transform(near, lambda d: F.col("cx") + d)).alias("cx"), "cy")
    wide = wide.withColumn("cy", F.explode(F.transform(near, lambda d: F.col("cy") + d)))
    j = own.select("file", F.col("c").alias("a"), "x", "y", "cx", "cy").join(wide, ["file", "cx", "cy"])
    d = F.sqrt((F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by")))
    j = j.where(F.col("a") < F.col("b")).withColumn("distance", d).where(F.col("distance") <= within)
    return j.groupBy(F.col("file").alias(file), "a", "b").agg(F.min("distance").alias("distance"))


def contours_to_annotations(contours: DataFrame, spacing: float | None = None, slide_spacing: float | None = None,
                            min_area: float = 0.0, add_area: bool = True, swap_xy: bool = False, area: str = "area",
                            keep: Sequence[str] = ("file", "group", "color")) -> DataFrame:
    """Contours (file, name, coords, ...) to polygon annotations: area (mm2 when ``spacing`` is given) in the name,
    small areas and contours with fewer than 3 points left out, coordinates scaled to the slide's spacing."""
    a = polygon_area("coords") if spacing is None else area_mm2("coords", spacing)
    x = contours.withColumn(area, a).where(F.size("coords") >= 3)
    if min_area > 0:
        x = x.where(F.col(area) >= min_area)
    name = F.coalesce(F.col("name"), F.lit(""))
    if add_area:
        small = F.col(area) < 1e-3
        name = F.concat(name, F.lit("_area_"), F.when(small, F.format_string("%.2e", F.col(area))).otherwise(
            F.format_string("%.3f", F.col(area))))
    factor = spacing / slide_spacing if spacing is not None and slide_spacing is not None else 1.0
    first, second = ("y", "x") if swap_xy else ("x", "y")
    coords = F.transform("coords", lambda p: F.struct((p[first].cast("double") * factor).alias("x"),
                                                      (p[second].cast("double") * factor).alias("y")))
    return x.select(*[c for c in keep if c in contours.columns], name.alias("name"), F.lit("Polygon").alias("type"),
                    coords.alias("coords"), area)
