"""Tile grids, tissue masks, sparse and dense bag views, grid transforms.

A tile is a row (name, i, j, feat); a slide may own any share of them, so everything works per tile or with map-side
partial aggregates, never per slide in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from bagframe.functions import scalars as S
from bagframe.functions.stats import ratio
from bagframe.operators.hot import COUNT, attach, attach_table
from bagframe.operators.narrowing import array_quantiles
from bagframe.operators.scan import hash60, ordered_scan
from bagframe.session import cut_lineage


def tile_grid(slides: DataFrame, stride: int, patch_size: int | None = None, height: str = "height",
              width: str = "width", partitions: int | None = None) -> DataFrame:
    """One row per grid cell: (slide columns..., i, j, y, x, read_y, read_x).

    Rows are repartitioned by (name, i) after the explode, because slide sizes differ widely.
    """
    patch = patch_size or stride
    if stride > patch:
        raise ValueError("stride must not be larger than the patch size")
    half = (patch - stride) // 2
    last = lambda c: F.floor((F.col(c) - 1) / stride)
    rows = slides.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last(height))))
    rows = rows.repartition(partitions, "name", "i") if partitions else rows.repartition("name", "i")
    cells = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), last(width))))
    return cells.withColumns({
        "y": F.col("i") * stride, "x": F.col("j") * stride,
        "read_y": F.col("i") * stride - half, "read_x": F.col("j") * stride - half})


def mask_fraction(tiles: DataFrame, mask: DataFrame, patch_size: int, stride: int, downsampling: float,
                  label: int | None = None) -> DataFrame:
    """(name, i, j, fraction): share of mask cells > 0 (or equal to ``label``) inside each tile.

    Mask cells are (name, mi, mj, v). Tile origins (i * stride, j * stride) and the patch size are scaled to mask cells
    and rounded half to even, so tiles may overlap; cells outside the mask count as zero. Only positive mask cells are
    sent on, each to the few tiles that can contain it, and counted there; pixels are never joined.
    """
    size, step = int(np.round(patch_size * downsampling)), stride * downsampling
    hit = (F.col("v") == label) if label is not None else (F.col("v") > 0)

    def owners(cell: str) -> Column:
        c = F.col(cell)
        near = F.sequence(F.greatest(F.floor((c - size) / step), F.lit(0)), F.greatest(F.floor(c / step) + 1, F.lit(0)))
        return F.filter(near, lambda k: (F.rint(k * step) <= c) & (c < F.rint(k * step) + size))

    hits = mask.where(hit).select("name", F.explode(owners("mi")).alias("i"), "mj").select(
        "name", "i", F.explode(owners("mj")).alias("j")).groupBy("name", "i", "j").agg(F.count(F.lit(1)).alias("__n"))
    return tiles.select("name", "i", "j").join(hits, ["name", "i", "j"], "left").select(
        "name", "i", "j", (F.coalesce("__n", F.lit(0)) / float(size * size)).alias("fraction"))


def aligned_mask_fraction(mask: DataFrame, cells_per_tile: int, label: int | None = None) -> DataFrame:
    """Tissue fraction when a tile covers exactly ``cells_per_tile`` mask cells per side: one aggregate, no join."""
    hit = (F.col("v") == label) if label is not None else (F.col("v") > 0)
    return mask.groupBy("name", F.floor(F.col("mi") / cells_per_tile).alias("i"),
                        F.floor(F.col("mj") / cells_per_tile).alias("j")).agg(F.avg(hit.cast("double")).alias("fraction"))


def keep_tissue(tiles: DataFrame, fractions: DataFrame | None = None, threshold: float = 0.2,
                column: str = "fraction") -> DataFrame:
    """Tiles with more than ``threshold`` tissue; without a mask every tile stays. Put this before any decoding."""
    if fractions is not None:
        tiles = tiles.join(fractions.select("name", "i", "j", column), ["name", "i", "j"])
    elif column not in tiles.columns:
        return tiles
    return tiles.where(F.col(column) > threshold)


def padded_region(cells: DataFrame, regions: DataFrame, value: str = "v") -> DataFrame:
    """Read regions (region, name, y, x, h, w) of a cell table (name, mi, mj, value); cells outside read as 0."""
    r = regions.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h").cast("long") - 1)))
    r = r.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w").cast("long") - 1)))
    r = r.withColumns({"mi": F.col("y") + F.col("r"), "mj": F.col("x") + F.col("c")})
    j = r.join(cells.select("name", "mi", "mj", value), ["name", "mi", "mj"], "left")
    return j.select("region", "name", "r", "c", F.coalesce(F.col(value), F.lit(0)).alias(value))


def is_background(feat: str = "feat") -> Column:
    """A constant vector marks background."""
    return F.array_max(feat) == F.array_min(feat)


def sparse_tiles(tiles: DataFrame, feat: str = "feat") -> DataFrame:
    """The storage form: background rows dropped."""
    return tiles.where(~is_background(feat))


def with_coordinates(tiles: DataFrame, stride: int) -> DataFrame:
    """Stored coordinates are (column, row) times stride."""
    return tiles.withColumns({"x": F.col("j") * stride, "y": F.col("i") * stride})


def shape_from_coordinates(tiles: DataFrame, downscale: int = 256, group: Sequence[str] = ("name",)) -> DataFrame:
    return tiles.groupBy(*group).agg((F.floor(F.max("y") / downscale) + 1).alias("h"),
                                     (F.floor(F.max("x") / downscale) + 1).alias("w"))


def stitch(sparse: DataFrame, shapes: DataFrame, dim: int, order: str | None = None) -> DataFrame:
    """Dense view: every cell of every slide's h x w grid, zeros where no tile is. When two tiles share a cell the
    later one (by ``order``) wins."""
    tiles = sparse
    if order is not None:
        tiles = sparse.groupBy("name", "i", "j").agg(F.max_by("feat", order).alias("feat"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    grid = shapes.select("name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)).alias("i"), "w")
    grid = grid.select("name", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)).alias("j"))
    return grid.join(tiles.select("name", "i", "j", "feat"), ["name", "i", "j"], "left").withColumn(
        "feat", F.coalesce("feat", zeros))


def lower_envelope(at: np.ndarray, first_at: np.ndarray, site: np.ndarray, height: np.ndarray, first_site: np.ndarray) -> np.ndarray:
    """Per position of many rows the smallest (position - site)^2 + height of its row's sites; rows begin at first_at and first_site (with the
    ends appended), both sorted inside a row. -1 where a row has no site.

    The best site never moves back as the position moves on, so the middle position of a stretch parts the sites for both halves: every level
    of halving looks at each site about once, all stretches of all rows together.
    """
    out = np.full(len(at), -1, np.int64)
    low, high = first_at[:-1].copy(), first_at[1:] - 1
    left, right = first_site[:-1].copy(), first_site[1:] - 1
    while True:
        some = (low <= high) & (left <= right)
        low, high, left, right = low[some], high[some], left[some], right[some]
        if not len(low):
            return out
        mid = (low + high) >> 1
        n = right - left + 1
        start = np.cumsum(n) - n
        k = np.arange(int(n.sum())) + np.repeat(left - start, n)
        cost = (np.repeat(at[mid], n) - site[k]) ** 2 + height[k]
        least = np.minimum.reduceat(cost, start)
        best = np.minimum.reduceat(np.where(cost == np.repeat(least, n), k, np.iinfo(np.int64).max), start)
        out[mid] = least
        low, high = np.concatenate([low, mid + 1]), np.concatenate([mid - 1, high])
        left, right = np.concatenate([left, best]), np.concatenate([best, right])


#: Cells whose envelopes are found together.
_CELLS = 1 << 20


@pandas_udf(ArrayType(LongType()))
def _row_envelope(js: pd.Series, gaps: pd.Series) -> pd.Series:
    """Per grid row: min over columns of (j - j')^2 + gap(j')^2, where gap is the distance inside the column."""
    sizes = np.array([len(j) for j in js], np.int64)
    chunk = (np.cumsum(sizes) - sizes) // _CELLS
    out = []
    for c in np.unique(chunk):
        rows = np.flatnonzero(chunk == c)
        at = np.concatenate([np.asarray(js.iloc[r], np.int64) for r in rows])
        gap = np.concatenate([np.asarray(gaps.iloc[r], np.float64) for r in rows])
        first = np.concatenate([[0], np.cumsum(sizes[rows])])
        known = np.isfinite(gap)
        sites = np.concatenate([[0], np.cumsum(known)])[first]
        d = lower_envelope(at, first, at[known], gap[known].astype(np.int64) ** 2, sites)
        out += [[None if v < 0 else v for v in d[a:b].tolist()] for a, b in zip(first[:-1], first[1:])]
    return pd.Series(out)


def _squared_distance(grid: DataFrame, tissue: str) -> DataFrame:
    """(name, i, j, tissue, __d2): squares of :func:`background_distance`, longs."""
    bg = F.col(tissue) == 0
    col = Window.partitionBy("name", "j").orderBy("i")
    above = F.max(F.when(bg, F.col("i"))).over(col.rowsBetween(Window.unboundedPreceding, 0))
    below = F.min(F.when(bg, F.col("i"))).over(col.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("i") - above, below - F.col("i")).cast("double")
    x = grid.select("name", "i", "j", F.col(tissue).alias("tissue"), F.coalesce(gap, F.lit(float("inf"))).alias("__g"))
    rows = x.groupBy("name", "i").agg(F.array_sort(F.collect_list(F.struct("j", "__g", "tissue"))).alias("__r"))
    rows = rows.withColumn("__d", _row_envelope(F.col("__r.j"), F.col("__r.__g")))
    cells = rows.select("name", "i", F.explode(F.arrays_zip(F.col("__r"), F.col("__d").alias("d"))).alias("z"))
    return cells.select("name", "i", F.col("z.__r.j").alias("j"), F.col("z.__r.tissue").alias(tissue), F.col("z.d").alias("__d2"))


def background_distance(grid: DataFrame, tissue: str = "tissue") -> DataFrame:
    """Add ``distance``: Euclidean distance of each tissue cell to the nearest background cell of its slide, 0 for
    background. The grid must be dense; the outside is not background; NULL when a slide has no background.

    Two passes: nearest background within the column by windows, then along each row. A task sees one grid column or
    one grid row of a slide, never a slide.
    """
    return _squared_distance(grid, tissue).withColumn("distance", F.sqrt("__d2")).drop("__d2")


def distance_map(grid: DataFrame, tissue: str = "tissue", percentile: float = 98.0) -> DataFrame:
    """Add ``weight``: distance / max, squared, zero below the percentile of the slide's cells, divided by its sum.

    Squared distances are whole numbers, of which a slide has few: maximum, percentile and sum come from their counts, and one
    join brings them to the cells.
    """
    d = _squared_distance(grid, tissue)
    counts = d.where(F.col("__d2").isNotNull()).groupBy("name", "__d2").agg(F.count(F.lit(1)).alias("n"))
    scan = ordered_scan(counts, "__d2", ["name"], ["n"])
    at = F.lit(percentile / 100.0) * (F.col("total_n") - 1)
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    pick = lambda pos: F.max(F.when((first <= pos) & (pos <= last), F.col("__d2")))
    share = lambda d2: F.pow(ratio(F.sqrt(d2), F.sqrt("__top")), F.lit(2.0))
    per = scan.groupBy("name").agg(pick(F.floor(at)).alias("__lo"), pick(F.ceil(at)).alias("__hi"), F.max(at - F.floor(at)).alias("__f"),
                                   F.max("__d2").alias("__top"), F.max("total_n").alias(COUNT))
    per = per.withColumn("__cut", share(F.col("__lo")) + (share(F.col("__hi")) - share(F.col("__lo"))) * F.col("__f")).select("name", "__top", "__cut", COUNT)
    kept = F.when(share(F.col("__d2")) < F.col("__cut"), 0.0).otherwise(share(F.col("__d2")))
    sums = counts.join(per, "name").groupBy("name", "__top", "__cut", COUNT).agg(F.sum(kept * F.col("n")).alias("__sum"))
    out = attach(d, sums, ["name"], "left")
    return out.select("name", "i", "j", tissue, F.sqrt("__d2").alias("distance"), ratio(kept, F.col("__sum")).alias("weight"))


def normalise_feature_map(tiles: DataFrame, feat: str = "feat", low: float = 3.0, high: float = 97.0) -> DataFrame:
    """Rescale vectors between the low and high percentile of the bag's non-zero values and clip to [0, 1]; zeros
    (background) stay NULL. The percentiles are exact and found without shuffling the entries."""
    q = cut_lineage(array_quantiles(tiles, "name", feat, [low / 100, high / 100], skip_zero=True))
    lo, span = F.col("quantiles")[0], F.col("quantiles")[1] - F.col("quantiles")[0] + 1e-6
    scaled = F.transform(feat, lambda v: F.when(v != 0, F.least(F.lit(1.0), F.greatest(
        F.lit(0.0), (v.cast("double") - lo) / span))))
    return attach(tiles, q, ["name"]).withColumn("scaled", scaled).drop("quantiles")


def bag_info(tiles: DataFrame, stride: int, feat: str = "feat") -> DataFrame:
    """(name, n, w_dim, h_dim, width, height, code_size) per stored bag; two code sizes in a bag are an error."""
    size = F.size(feat)
    bad = F.raise_error(F.concat(F.lit("different code sizes in "), F.first("name"))).cast("int")
    return tiles.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), (F.max("j") + 1).alias("w_dim"), (F.max("i") + 1).alias("h_dim"),
        ((F.max("j") + 1) * stride).alias("width"), ((F.max("i") + 1) * stride).alias("height"),
        F.when(F.min(size) != F.max(size), bad).otherwise(F.max(size)).alias("code_size"))


def flip(tiles: DataFrame, shapes: DataFrame, horizontal: Column | bool = False, vertical: Column | bool = False) -> DataFrame:
    """Mirror the grid: horizontally the column, vertically the row index changes. Conditions may be columns, for
    instance a hash of the name."""
    h = horizontal if isinstance(horizontal, Column) else F.lit(horizontal)
    v = vertical if isinstance(vertical, Column) else F.lit(vertical)
    t = attach_table(tiles, shapes.select("name", "h", "w"), ["name"])
    return t.withColumns({"j": F.when(h, F.col("w") - 1 - F.col("j")).otherwise(F.col("j")),
                          "i": F.when(v, F.col("h") - 1 - F.col("i")).otherwise(F.col("i"))}).select(*tiles.columns)


def rotate(tiles: DataFrame, shapes: DataFrame, quarters: Column | int = 1) -> DataFrame:
    """Rotate the grid counter-clockwise by ``quarters`` x 90 degrees (number or column)."""
    k = (quarters if isinstance(quarters, Column) else F.lit(quarters)) % 4
    t = attach_table(tiles, shapes.select("name", "h", "w"), ["name"])
    i, j, h, w = (F.col(c) for c in ("i", "j", "h", "w"))
    ni = F.when(k == 1, w - 1 - j).when(k == 2, h - 1 - i).when(k == 3, j).otherwise(i)
    nj = F.when(k == 1, i).when(k == 2, w - 1 - j).when(k == 3, h - 1 - i).otherwise(j)
    return t.withColumns({"i": ni, "j": nj}).select(*tiles.columns)


def random_choice(name: str, seed: int, salt: str, n: int) -> Column:
    """A reproducible choice 0..n-1 per name."""
    return (hash60(F.lit(str(seed)), F.lit(salt), F.col(name)) % n).cast("int")


def crop_pad(tiles: DataFrame, shapes: DataFrame, size: tuple[int, int], wiggle: float = 0.0, seed: int = 1,
             drop_outside: bool = True) -> DataFrame:
    """Crop or pad the grid around its centre to ``size`` (h, w): cells move by start = size//2 - centre.

    ``wiggle`` shifts the centre by up to wiggle * surplus / 2 cells, chosen by a hash of the name (1 is a random
    crop). Padding is implicit: cells without a tile are zero.
    """
    t = attach_table(tiles, shapes.select("name", "h", "w"), ["name"])

    def moved(cell: str, dim: str, target: int) -> Column:
        centre = F.floor(F.col(dim) / 2)
        if wiggle:
            reach = F.floor(F.greatest(F.col(dim) - target, F.lit(0)) * float(wiggle) * 0.5)
            shift = hash60(F.lit(str(seed)), F.lit(cell), F.col("name")) % (2 * reach + 1) - reach
            centre = F.least(F.greatest(centre + shift, F.lit(0)), F.col(dim))
        return (F.col(cell) - centre + target // 2).cast("long")

    t = t.withColumns({"i": moved("i", "h", size[0]), "j": moved("j", "w", size[1])})
    if drop_outside:
        t = t.where((F.col("i") >= 0) & (F.col("i") < size[0]) & (F.col("j") >= 0) & (F.col("j") < size[1]))
    return t.select(*tiles.columns)


# The spacings a slide summary reports, in micrometres per pixel.
SUMMARY_SPACINGS = (0.25, 0.5, 1, 2, 4, 8)


def _flag_name(spacing: float) -> str:
    return ("has_sp%.2f" % spacing).rstrip("0").replace(".", "")


def slide_summary(levels: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Summary rows from (name, spacings ARRAY<DOUBLE>, shapes ARRAY<STRUCT<h,w>>, filesize): size, levels, area in
    whole mm2 and one flag per common spacing that some level matches."""
    sp, top = F.col("spacings"), F.col("shapes")[0]
    flags = {_flag_name(s): S.closest_level(sp, float(s), tolerance).isNotNull() for s in SUMMARY_SPACINGS}
    return levels.select(
        "name", sp[0].alias("spacing"), top["w"].alias("width"), top["h"].alias("height"),
        F.size(sp).alias("n_levels"), "spacings", F.array_min(sp).alias("spacing_min"), F.array_max(sp).alias("spacing_max"),
        top.alias("shape"), "shapes", "filesize",
        S.px_to_mm2(top["w"].cast("double") * top["h"], sp[0]).cast("long").alias("area"),
        *[e.alias(n) for n, e in flags.items()])
