"""Annotation tables: (file, name, type, group, color, coords ARRAY<STRUCT<x,y>>) and groups (file, name, parent, color)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagframe.operators.geometry import centroid

# Default colours of groups and annotations.
GROUP_COLOR, ANNO_COLOR = "#FF0000", "#000000"


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def scale(annos: DataFrame, factor: Column | float | None = None, from_spacing: float | None = None,
          to_spacing: float | None = None, round_result: bool = False) -> DataFrame:
    """Multiply coordinates by a factor, or by from_spacing / to_spacing; a given factor wins. Rounding is half to
    even."""
    if factor is None:
        if from_spacing is None or to_spacing is None:
            raise ValueError("needs a factor or both spacings")
        factor = from_spacing / to_spacing
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    end = F.rint if round_result else (lambda c: c)
    return annos.withColumn("coords", F.transform("coords", lambda p: _point(end(p["x"] * f), end(p["y"] * f))))


def round_coordinates(annos: DataFrame) -> DataFrame:
    return scale(annos, 1.0, round_result=True)


def shift(annos: DataFrame, x: Column | float, y: Column | float, round_result: bool = False) -> DataFrame:
    dx = x if isinstance(x, Column) else F.lit(float(x))
    dy = y if isinstance(y, Column) else F.lit(float(y))
    end = F.rint if round_result else (lambda c: c)
    return annos.withColumn("coords", F.transform("coords", lambda p: _point(end(p["x"] + dx), end(p["y"] + dy))))


# File name forms that end in the offset of a crop, as (regular expression of name, x, y).
SUFFIX_FORMS = {
    "__": r"^(.*)__(\d+)_(\d+)$",
    "tl_br": r"^(.*?)_+(\d+)_+(\d+)_+\d+_+\d+$",
    "tl": r"^(.*?)_+(\d+)_+(\d+)$",
}


def unshift_by_name(annos: DataFrame, form: str = "__", file: str = "file") -> DataFrame:
    """Move crop annotations back to the slide: the offset is read from the end of the file name and added, and the
    file name loses it. Coordinates are rounded first. A name without offset is an error."""
    pattern = SUFFIX_FORMS[form]
    stem = F.col(file)
    part = [F.regexp_extract(stem, pattern, k) for k in (1, 2, 3)]
    bad = F.raise_error(F.concat(F.lit("no offset in the name "), stem)).cast("double")
    x = F.when(part[1] == "", bad).otherwise(part[1].try_cast("double"))
    out = round_coordinates(annos).withColumns({"__x": x, "__y": part[2].try_cast("double"), "__f": part[0]})
    return shift(out, F.col("__x"), F.col("__y")).withColumn(file, F.col("__f")).drop("__x", "__y", "__f")


def in_groups(annos: DataFrame, groups: Sequence[str]) -> DataFrame:
    return annos.where(F.col("group").isin(list(groups)))


def delete_groups(annos: DataFrame, groups: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(annotations, groups) without the named groups."""
    return annos.where(~F.col("group").isin(list(names))), groups.where(~F.col("name").isin(list(names)))


def keep_groups(annos: DataFrame, groups: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Delete every declared group that is not named; annotations of undeclared groups stay."""
    gone = groups.where(~F.col("name").isin(list(names))).select(F.col("file"), F.col("name").alias("group")).distinct()
    return annos.join(gone, ["file", "group"], "left_anti"), groups.where(F.col("name").isin(list(names)))


def remove_annotations(annos: DataFrame, names: Sequence[str]) -> DataFrame:
    return annos.where(~F.col("name").isin(list(names)))


def _renamed(c: str, mapping: Mapping[str, str], strip: bool) -> Column:
    """Pairs are applied one after the other."""
    e = F.trim(F.col(c)) if strip else F.col(c)
    for old, new in mapping.items():
        e = F.when(e == old, F.lit(new)).otherwise(e)
    return e


def rename_groups(annos: DataFrame, groups: DataFrame, mapping: Mapping[str, str], strip: bool = False,
                  position: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Rename in both tables; of groups that become equal in a file the first (by ``position``) stays."""
    a = annos.withColumn("group", _renamed("group", mapping, strip))
    g = groups.withColumn("name", _renamed("name", mapping, strip))
    rest = [c for c in g.columns if c not in ("file", "name")]
    g = g.groupBy("file", "name").agg(F.min_by(F.struct(*rest), F.col(position)).alias("__r")).select(
        "file", "name", *[F.col("__r")[c].alias(c) for c in rest])
    return a, g.select(*groups.columns)


def recolour_groups(groups: DataFrame, colors: Mapping[str, str]) -> DataFrame:
    e = F.col("color")
    for name, color in colors.items():
        e = F.when(F.col("name") == name, F.lit(color)).otherwise(e)
    return groups.withColumn("color", e)


def affix_names(annos: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    return annos.withColumn("name", F.concat(F.lit(prefix), F.col("name"), F.lit(suffix)))


def merge_sets(annos1: DataFrame, groups1: DataFrame, annos2: DataFrame, groups2: DataFrame, suffix1: str = "",
               suffix2: str = " new", prefix1: str = "", prefix2: str = "", rename1: Mapping[str, str] | None = None,
               rename2: Mapping[str, str] | None = None, colors1: Mapping[str, str] | None = None,
               colors2: Mapping[str, str] | None = None, position: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Two annotation sets of the same files: groups united by name (the first set's win), all annotations kept."""
    a1, g1 = rename_groups(annos1, groups1, rename1 or {}, position=position)
    a2, g2 = rename_groups(annos2, groups2, rename2 or {}, position=position)
    g1, g2 = recolour_groups(g1, colors1 or {}), recolour_groups(g2, colors2 or {})
    new = g2.join(g1.select("file", "name"), ["file", "name"], "left_anti").select(*g1.columns)
    return affix_names(a1, prefix1, suffix1).unionByName(affix_names(a2, prefix2, suffix2)), g1.unionByName(new)


def to_dots(annos: DataFrame, groups: Sequence[str] | None = None, types: Sequence[str] = ("Rectangle", "Polygon"),
            replace: bool = False, name_suffix: str = "_dot") -> DataFrame:
    """Polygons and rectangles to the dot at their centroid, replacing them or added under a suffixed name."""
    pick = F.col("type").isin(list(types))
    if groups is not None:
        pick = pick & F.coalesce(F.col("group").isin(list(groups)), F.lit(False))
    return _converted(annos, pick, "Dot", F.array(centroid("coords")), replace, name_suffix)


def box_around(p: Column, distance: float) -> Column:
    """Square of half side ``distance``: corners clockwise from the top right."""
    return F.array(*[_point(p["x"] + sx * distance, p["y"] + sy * distance)
                     for sx, sy in ((1, 1), (1, -1), (-1, -1), (-1, 1))])


def dots_to_boxes(annos: DataFrame, distance: float, groups: Sequence[str] | None = None, replace: bool = False,
                  name_suffix: str = "_box", spacing: float | None = None) -> DataFrame:
    """Dots to squares. ``distance`` is in pixels, or in micrometres (rounded to pixels) when ``spacing`` is given."""
    d = distance if spacing is None else float(round(distance / spacing))
    pick = F.col("type") == "Dot"
    if groups is not None:
        pick = pick & F.coalesce(F.col("group").isin(list(groups)), F.lit(False))
    return _converted(annos, pick, "Rectangle", box_around(F.col("coords")[0], d), replace, name_suffix)


def _converted(annos: DataFrame, pick: Column, kind: str, coords: Column, replace: bool, name_suffix: str) -> DataFrame:
    if replace:
        return annos.withColumns({"coords": F.when(pick, coords).otherwise(F.col("coords")),
                                  "type": F.when(pick, F.lit(kind)).otherwise(F.col("type"))})
    added = annos.where(pick).withColumns({"coords": coords, "type": F.lit(kind),
                                           "name": F.concat(F.col("name"), F.lit(name_suffix))})
    return annos.unionByName(added)


def rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corner coordinates from position and size."""
    return F.array(_point(x, y), _point(x + w, y), _point(x + w, y + h), _point(x, y + h))


def info(annos: DataFrame) -> DataFrame:
    """(file, type, name, n_coords, broken): a polygon with a single coordinate is broken."""
    n = F.size("coords")
    return annos.select("file", "type", "name", n.alias("n_coords"), ((F.col("type") == "Polygon") & (n == 1)).alias("broken"))


def same_coordinates(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("file", "name")) -> DataFrame:
    """(keys..., same) for annotations present in both tables."""
    right = b.select(*keys, F.col("coords").alias("__c"))
    return a.join(right, list(keys)).select(*keys, (F.col("coords") == F.col("__c")).alias("same"))


def with_group_color(annos: DataFrame, groups: DataFrame) -> DataFrame:
    """Colour of the annotation's group; its own colour when it has no group."""
    g = groups.groupBy("file", F.col("name").alias("group")).agg(F.first("color", True).alias("__gc"))
    x = annos.join(g, ["file", "group"], "left")
    own = F.col("group").isNull() | (F.col("group") == "None")
    return x.withColumn("color", F.when(own, F.col("color")).otherwise(F.coalesce("__gc", "color"))).drop("__gc").select(
        *annos.columns)


def first_by_name(annos: DataFrame, name: str, position: str = "pos") -> DataFrame:
    """The first annotation of that name in every file."""
    rest = [c for c in annos.columns if c != "file"]
    return annos.where(F.col("name") == name).groupBy("file").agg(
        F.min_by(F.struct(*rest), F.col(position)).alias("__r")).select("file", *[F.col("__r")[c].alias(c) for c in rest])
