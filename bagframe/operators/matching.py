"""Matching files by name: prefix joins without a cross join.

``target.stem starts with name`` becomes an equi-join: every target stem emits its prefixes, but only of lengths that
occur among the names (file names have at most 255 characters), so no false pairs are formed and a common leading text
such as a study id does not create a hot key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagframe.functions import scalars as S


def _replaced(c: Column, replacements: Mapping[str, str] | None) -> Column:
    for old, new in (replacements or {}).items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def prefix_join(names: DataFrame, targets: DataFrame, name: str, path: str, same_name: bool = False,
                replacements: Mapping[str, str] | None = None) -> DataFrame:
    """All (name, path) pairs where the target's stem starts with (or equals) the name."""
    n = names.select(F.col(name).alias("name")).distinct()
    t = targets.select(F.col(path).alias("path")).withColumn("__stem", _replaced(S.stem("path"), replacements))
    if same_name:
        return t.join(n, F.col("__stem") == F.col("name")).select("name", "path")
    lengths = n.agg(F.array_sort(F.collect_set(F.length("name"))).alias("l"))
    t = t.withColumn("__len", F.explode(lengths.scalar())).where(F.col("__len") <= F.length("__stem"))
    t = t.select("path", F.col("__stem").substr(F.lit(1), F.col("__len")).alias("name"))
    return t.join(n, "name").select("name", "path")


def match_paths(names: DataFrame, targets: DataFrame, name: str, path: str = "path", same_name: bool = False,
                take_shortest: bool = False, replacements: Mapping[str, str] | None = None,
                missing: str = "null") -> DataFrame:
    """One row per name: (name, path, n_hits).

    Several hits keep the shortest path (then the alphabetically first) with ``take_shortest`` and are an error
    otherwise. A name without hit has a NULL path (``missing='null'``), is dropped ('drop') or is an error ('error').
    """
    hits = prefix_join(names, targets, name, path, same_name, replacements).groupBy("name").agg(
        F.min(F.struct(F.length("path").alias("len"), F.col("path"))).alias("best"), F.count(F.lit(1)).alias("n_hits"))
    all_names = names.select(F.col(name).alias("name"))
    out = all_names.join(hits, "name", "left" if missing != "drop" else "inner").select(
        "name", F.col("best.path").alias("path"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))
    p = F.col("path")
    if not take_shortest:
        many = F.raise_error(F.concat(F.lit("too many files found for "), F.col("name"))).cast("string")
        p = F.when(F.col("n_hits") > 1, many).otherwise(p)
    if missing == "error":
        none = F.raise_error(F.concat(F.lit("no match for "), F.col("name"))).cast("string")
        p = F.when(F.col("n_hits") == 0, none).otherwise(p)
    return out.withColumn("path", p)


def match_both_ways(sources: DataFrame, targets: DataFrame, path: str = "path",
                    replacements: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source, target) matches, sources without match, targets without match."""
    s = sources.select(F.col(path).alias("source")).withColumn("name", _replaced(S.stem("source"), replacements))
    hits = match_paths(s, targets, "name", path, take_shortest=True, missing="drop").select("name", "path")
    found = s.join(hits, "name").select("source", F.col("path").alias("target"))
    return (found, sources.join(found.select(F.col("source").alias(path)), path, "left_anti"),
            targets.join(found.select(F.col("target").alias(path)), path, "left_anti"))


def first_directory_wins(directories: Sequence[DataFrame], path: str = "path") -> DataFrame:
    """One path per stem; a directory listed earlier wins, then the first path."""
    tagged = None
    for rank, d in enumerate(directories):
        t = d.select(F.col(path).alias("path"), F.lit(rank).alias("rank"))
        tagged = t if tagged is None else tagged.unionByName(t)
    best = tagged.groupBy(S.stem("path").alias("stem")).agg(F.min(F.struct("rank", "path")).alias("b"))
    return best.select("stem", F.col("b.path").alias("path"))


def link_table(images: DataFrame, annotations: DataFrame | Sequence[DataFrame] | None, masks: DataFrame | None,
               path: str = "path", only_with_annotation: bool = False, only_with_mask: bool = False,
               take_shortest: bool = False, same_name: bool = False) -> DataFrame:
    """(image, annotation, mask) per image; images with neither are left out."""
    if annotations is None and masks is None:
        raise ValueError("either annotations or masks must be given")
    out = images.select(F.col(path).alias("image")).withColumn("name", S.stem("image"))
    names = out.select("name").distinct()
    none = F.lit(None).cast("string")
    if annotations is not None:
        if not isinstance(annotations, DataFrame):
            annotations = first_directory_wins(annotations, path).select(F.col("path").alias(path))
        a = match_paths(names, annotations, "name", path, same_name=same_name, take_shortest=take_shortest)
        out = out.join(a.select("name", F.col("path").alias("annotation")), "name", "left")
    else:
        out = out.withColumn("annotation", none)
    if masks is not None:
        m = match_paths(names, masks, "name", path, take_shortest=take_shortest)
        out = out.join(m.select("name", F.col("path").alias("mask")), "name", "left")
    else:
        out = out.withColumn("mask", none)
    keep = F.col("annotation").isNotNull() | F.col("mask").isNotNull()
    if only_with_annotation:
        keep = keep & F.col("annotation").isNotNull()
    if only_with_mask:
        keep = keep & F.col("mask").isNotNull()
    return out.where(keep).select("image", "annotation", "mask")
