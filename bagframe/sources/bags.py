"""Bag storage: a tile table and a slide table in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagframe.operators.tiles import bag_info, sparse_tiles, with_coordinates


def write_bags(tiles: DataFrame, path: str, stride: int, spacing: float, patch_size: int, overwrite: bool = False,
               files_per_write: int | None = None) -> None:
    """Background tiles are dropped; vectors are stored as FLOAT with (x, y) coordinates, next to one info row per
    bag. Rows are clustered by name so that reading a few bags prunes row groups; a hot bag is spread over several
    files by its row number."""
    mode = "overwrite" if overwrite else "error"
    sparse = with_coordinates(sparse_tiles(tiles), stride).withColumn("feat", F.col("feat").cast("array<float>"))
    parts = [files_per_write] if files_per_write else []
    sparse.repartitionByRange(*parts, "name", "i").sortWithinPartitions("name", "i", "j").write.mode(mode).parquet(f"{path}/tiles")
    info = bag_info(sparse, stride).withColumns({"stride": F.lit(stride), "spacing": F.lit(float(spacing)),
                                                 "patch_size": F.lit(patch_size)})
    info.write.mode(mode).parquet(f"{path}/slides")


def read_bags(spark: SparkSession, path: str, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tiles, slides), optionally only of the listed names."""
    tiles, slides = spark.read.parquet(f"{path}/tiles"), spark.read.parquet(f"{path}/slides")
    if names is not None:
        names = names.select("name")
        return tiles.join(names, "name", "left_semi"), slides.join(names, "name", "left_semi")
    return tiles, slides


def tiles_with_info(spark: SparkSession, path: str) -> DataFrame:
    tiles, slides = read_bags(spark, path)
    return tiles.join(slides, "name")


def common_code_size(slides: DataFrame) -> int:
    """The one vector width of all bags; different widths are an error."""
    r = slides.agg(F.min("code_size").alias("lo"), F.max("code_size").alias("hi")).first()
    if r["lo"] != r["hi"]:
        raise ValueError(f"different code sizes: {r['lo']} to {r['hi']}")
    return r["lo"]


def verify_bags(cohort: DataFrame, slides: DataFrame) -> DataFrame:
    """(name, side) of names that are only in the cohort or only in the store; empty when both agree."""
    only = cohort.select("name").join(slides.select("name"), "name", "left_anti").withColumn("side", F.lit("cohort"))
    return only.unionByName(slides.select("name").join(cohort.select("name"), "name", "left_anti").withColumn(
        "side", F.lit("store")))


def save_attention(att: DataFrame, path: str, overwrite: bool = False) -> None:
    """Attention cells (name, cls, i, j, a_raw, a_soft), appended unless overwritten."""
    cols = [c for c in ("name", "cls", "i", "j", "a_raw", "a_soft") if c in att.columns]
    att.select(*cols).write.mode("overwrite" if overwrite else "append").parquet(path)
