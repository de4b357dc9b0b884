"""File inventories from directory listings (file contents are never read)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagframe.functions import scalars as S


def list_files(spark: SparkSession, directories: str | Sequence[str], pattern: str | None = None, recursive: bool = False
               ) -> DataFrame:
    """(path, length, modificationTime, name, suffix) of one or more (comma separated) directories."""
    dirs = directories.split(",") if isinstance(directories, str) else list(directories)
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    df = r.load([d.strip() for d in dirs]).select("path", "length", "modificationTime")
    return df.withColumns({"name": S.stem("path"), "suffix": S.suffix("path")})


def cached_inventory(spark: SparkSession, directory: str, infos: str, pattern: str | None = None) -> DataFrame:
    """(name, suffix, path, ...) of a directory: its infos CSV when there is one, else a listing. Names in the CSV
    that still carry their suffix are split."""
    try:
        df = spark.read.csv(f"{directory.rstrip('/')}/{infos}", header=True)
    except AnalysisException:
        return list_files(spark, directory, pattern).select("name", "suffix", "path")
    if "suffix" not in df.columns:
        df = df.withColumns({"suffix": S.suffix("name"), "name": S.stem("name")})
    return df.withColumn("path", F.concat(F.lit(directory.rstrip("/") + "/"), "name", "suffix"))


def unique_names(df: DataFrame) -> DataFrame:
    """The inventory itself; a name found twice (in one or several directories) is an error."""
    twice = df.groupBy("name").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"file name is not unique: {twice[0]['name']}")
    return df


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _list(v) -> list[str]:
    return [] if v is None else v.split(",") if isinstance(v, str) else list(v)


def filter_paths(df: DataFrame, path: str = "path", containing_any=None, containing_all=None, not_containing=None,
                 endings=None, ignore_dots: bool = True, ignore_case: bool = False, depth: int | None = None,
                 root: str = "") -> DataFrame:
    """Select paths by text: tests look at the file name, or with ``ignore_case`` at the whole path in any case.
    ``depth`` limits the number of folders below ``root``."""
    p = F.col(path)
    text = F.lower(p) if ignore_case else S.file_name(p)
    fold = str.lower if ignore_case else str
    keep = [F.lit(True)]
    if _list(containing_any):
        keep.append(_any([text.contains(fold(t)) for t in _list(containing_any)]))
    keep += [text.contains(fold(t)) for t in _list(containing_all)]
    keep += [~text.contains(fold(t)) for t in _list(not_containing)]
    if _list(endings):
        keep.append(_any([S.file_name(p).endswith(e) for e in _list(endings)]))
    if ignore_dots and not ignore_case:
        keep.append(~S.file_name(p).startswith("."))
    if depth is not None:
        start = len(root if root.endswith("/") else root + "/") + 1
        below = F.size(F.split(F.substr(p, F.lit(start)), "/"))
        keep.append(below <= depth)
    return df.where(reduce(lambda a, b: a & b, keep))


def name_path_table(df: DataFrame, path: str = "path", ending: str = "tif") -> DataFrame:
    """(name, path) of all files with an ending, sorted by path."""
    return df.where(S.file_name(path).endswith(ending)).select(S.stem(path).alias("name"), F.col(path).alias("path")).orderBy("path")


def write_infos(df: DataFrame, path: str, with_path: bool = False, overwrite: bool = True) -> None:
    out = df if with_path else df.drop("path")
    out.write.mode("overwrite" if overwrite else "error").csv(path, header=True)


def with_existing_files(df: DataFrame, inventory: DataFrame, path: str = "image") -> DataFrame:
    """Rows whose file is in the inventory."""
    return df.join(inventory.select(F.col("path").alias(path)), path, "left_semi")
