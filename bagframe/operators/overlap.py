"""Annotations that intersect region polygons, by an index of edges; built-in functions only.

Every edge is in the grid cells it passes, and in the grid rows it spans. Edges of both sides meet by cell; whether a shape lies
inside another is the parity of the edges that a ray from one of its vertices crosses, and those are in the vertex's row. A polygon of
many vertices is many rows of short edges, never one large cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = ("__k1", "__k2")


def _keyed(df: DataFrame, coords: str, file: str) -> DataFrame:
    """(file, __k1, __k2, coords as doubles, box): 128 bits of the row, so equal rows are one shape."""
    c = [F.col(f"`{n}`") for n in df.columns]
    points = F.transform(F.col(coords), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    out = df.withColumns({"__k1": F.xxhash64(*c), "__k2": F.xxhash64(F.lit(1), *c), "__p": points}).where(F.size("__p") > 0)
    ends = {n: fn(F.transform("__p", lambda p: p[a])) for n, fn, a in (("x0", F.array_min, "x"), ("y0", F.array_min, "y"), ("x1", F.array_max, "x"), ("y1", F.array_max, "y"))}  # noqa: B023
    return out.select(F.col(file).alias("__file"), *_KEY, "__p", F.struct(*[e.alias(n) for n, e in ends.items()]).alias("box"))


def _edges(shapes: DataFrame) -> DataFrame:
    """(file, key, ax, ay, bx, by, n): a row per edge; a point has one without length."""
    turned = F.concat(F.slice("__p", 2, F.greatest(F.size("__p") - 1, F.lit(0))), F.slice("__p", 1, 1))
    e = shapes.select("__file", *_KEY, F.size("__p").alias("n"), F.explode(F.arrays_zip(F.col("__p").alias("a"), turned.alias("b"))).alias("e"))
    return e.select("__file", *_KEY, "n", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def _spans(lo: Column, hi: Column, cell: float) -> Column:
    return F.sequence(F.floor(lo / cell), F.floor(hi / cell))


def _in_cells(edges: DataFrame, cell: float) -> DataFrame:
    """A row per cell that the edge passes: per grid column, the rows between the heights at which it enters and leaves."""
    c = F.col
    x = edges.withColumn("cx", F.explode(_spans(F.least("ax", "bx"), F.greatest("ax", "bx"), cell)))
    steep = F.when(c("ax") == c("bx"), F.lit(None)).otherwise((c("by") - c("ay")) / (c("bx") - c("ax")))
    at = lambda v: c("ay") + (F.least(F.greatest(v, F.least("ax", "bx")), F.greatest("ax", "bx")) - c("ax")) * steep
    enters, leaves = at(c("cx") * cell), at((c("cx") + 1) * cell)
    pad = cell * 1e-9                                    # rounding must not lose a cell
    low = F.greatest(F.least("ay", "by"), F.coalesce(F.least(enters, leaves) - pad, F.least("ay", "by")))
    high = F.least(F.greatest("ay", "by"), F.coalesce(F.greatest(enters, leaves) + pad, F.greatest("ay", "by")))
    return x.withColumn("cy", F.explode(_spans(F.least(low, high), F.greatest(low, high), cell)))


def _side(a: str, b: str, p: str) -> Column:
    """Which side of the line a b the point is on: -1, 0 or 1."""
    c = F.col
    return F.signum((c(f"{b}x") - c(f"{a}x")) * (c(f"{p}y") - c(f"{a}y")) - (c(f"{b}y") - c(f"{a}y")) * (c(f"{p}x") - c(f"{a}x")))


def _meeting(annos: DataFrame, regions: DataFrame, cell: float) -> DataFrame:
    """(keys of both): shapes of which an edge touches an edge of the region, contact along a line included."""
    a = _in_cells(_edges(annos).where("n > 1"), cell).drop("n")
    r = _in_cells(_edges(regions), cell).select("__file", "cx", "cy", *[F.col(k).alias(f"r{k}") for k in _KEY],
                                                *[F.col(o).alias(n) for o, n in (("ax", "cx_"), ("ay", "cy_"), ("bx", "dx_"), ("by", "dy_"))])
    j = a.join(r, ["__file", "cx", "cy"])
    j = j.withColumnsRenamed({"cx": "cell_x", "cy": "cell_y"}).withColumnsRenamed({"cx_": "cx", "cy_": "cy", "dx_": "dx", "dy_": "dy"})
    boxes = [(F.least(f"a{v}", f"b{v}") <= F.greatest(f"c{v}", f"d{v}")) & (F.least(f"c{v}", f"d{v}") <= F.greatest(f"a{v}", f"b{v}")) for v in "xy"]
    apart = (_side("a", "b", "c") * _side("a", "b", "d") > 0) | (_side("c", "d", "a") * _side("c", "d", "b") > 0)
    return j.where(boxes[0] & boxes[1] & ~apart).select(*_KEY, *[f"r{k}" for k in _KEY]).distinct()


def _holding(pairs: DataFrame, holders: DataFrame, holder_keys: list[str], cell: float) -> DataFrame:
    """pairs with (odd, border): whether the ray to the right of (px, py) crosses an odd number of the holder's edges, and whether the
    point lies on one. A pair whose row has no edge of the holder is left out: it is outside."""
    c = F.col
    rows = _edges(holders).withColumn("row", F.explode(_spans(F.least("ay", "by"), F.greatest("ay", "by"), cell)))
    rows = rows.select(*[F.col(k).alias(h) for k, h in zip(_KEY, holder_keys)], "row", "ax", "ay", "bx", "by")
    j = pairs.withColumn("row", F.floor(c("py") / cell)).join(rows, [*holder_keys, "row"])
    crosses = (c("ay") > c("py")) != (c("by") > c("py"))
    at = (c("bx") - c("ax")) * (c("py") - c("ay")) / F.when(c("by") == c("ay"), 1.0).otherwise(c("by") - c("ay")) + c("ax")
    on = ((c("bx") - c("ax")) * (c("py") - c("ay")) - (c("by") - c("ay")) * (c("px") - c("ax")) == 0) & c("px").between(
        F.least("ax", "bx"), F.greatest("ax", "bx")) & c("py").between(F.least("ay", "by"), F.greatest("ay", "by"))
    keys = [*_KEY, *[f"r{k}" for k in _KEY]]
    return j.groupBy(*keys).agg((F.count_if(crosses & (c("px") < at)) % 2 == 1).alias("odd"), F.max(on).alias("border"), F.max("points").alias("points"))


def intersecting(annos: DataFrame, regions: DataFrame, cell: float = 1024.0, file: str = "file", coords: str = "coords", name: str = "name") -> DataFrame:
    """(file, region, columns of annos): annotations that intersect a region polygon of the same file. A point must lie strictly inside;
    other shapes must share a point with the region. Shapes without coordinates intersect nothing, nor do those of a null file; equal
    rows keep their number."""
    a, r = _keyed(annos, coords, file).distinct(), _keyed(regions, coords, file).distinct()
    met = _meeting(a, r, cell)
    boxed = lambda d: d.withColumn("cx", F.explode(_spans(F.col("box.x0"), F.col("box.x1"), cell))).withColumn(
        "cy", F.explode(_spans(F.col("box.y0"), F.col("box.y1"), cell)))
    first = F.element_at("__p", 1)
    other = r.select("__file", *[F.col(k).alias(f"r{k}") for k in _KEY], first.alias("rp"), F.col("box").alias("rbox"))
    other = other.withColumn("cx", F.explode(_spans(F.col("rbox.x0"), F.col("rbox.x1"), cell))).withColumn("cy", F.explode(_spans(F.col("rbox.y0"), F.col("rbox.y1"), cell)))
    own = boxed(a.select("__file", *_KEY, first.alias("ap"), F.size("__p").alias("points"), "box"))
    j = own.join(other, ["__file", "cx", "cy"])
    b, q = F.col("box"), F.col("rbox")
    once = (F.col("cx") == F.floor(F.greatest(b["x0"], q["x0"]) / cell)) & (F.col("cy") == F.floor(F.greatest(b["y0"], q["y0"]) / cell))
    touch = (b["x0"] <= q["x1"]) & (q["x0"] <= b["x1"]) & (b["y0"] <= q["y1"]) & (q["y0"] <= b["y1"])
    keys = [*_KEY, *[f"r{k}" for k in _KEY]]
    pairs = j.where(once & touch).join(met, keys, "left_anti")
    ap, rp = F.col("ap"), F.col("rp")
    in_region = _holding(pairs.select(*keys, "points", ap["x"].alias("px"), ap["y"].alias("py")), r, [f"r{k}" for k in _KEY], cell)
    in_region = in_region.where(F.col("odd") & ((F.col("points") > 1) | ~F.col("border"))).select(*keys)
    around = _holding(pairs.where("points > 1").select(*keys, "points", rp["x"].alias("px"), rp["y"].alias("py")), a, list(_KEY), cell)
    found = met.unionByName(in_region).unionByName(around.where("odd").select(*keys)).distinct()
    rows = annos.withColumns({"__k1": F.xxhash64(*[F.col(f"`{n}`") for n in annos.columns]), "__k2": F.xxhash64(F.lit(1), *[F.col(f"`{n}`") for n in annos.columns])})
    named = regions.select(F.xxhash64(*[F.col(f"`{n}`") for n in regions.columns]).alias("r__k1"), F.xxhash64(F.lit(1), *[F.col(f"`{n}`") for n in regions.columns]).alias("r__k2"),
                           F.col(name).alias("region"))
    return rows.join(found, list(_KEY)).join(named, ["r__k1", "r__k2"]).select(file, "region", *[F.col(f"`{n}`") for n in annos.columns if n != file])
