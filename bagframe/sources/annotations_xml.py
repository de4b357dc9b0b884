"""Annotation files in XML: ``Annotations/Annotation/Coordinates/Coordinate`` and ``AnnotationGroups/Group``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagframe.functions import scalars as S
from bagframe.operators.annotations import ANNO_COLOR, GROUP_COLOR

# Element and attribute names of the file format (a leading _ marks an attribute).
POINT = "struct<_Order:int,_X:string,_Y:string>"
ANNOTATION = (f"struct<_Name:string,_Type:string,_PartOfGroup:string,_Color:string,"
              f"Coordinates:struct<Coordinate:array<{POINT}>>>")
GROUP = "struct<_Name:string,_PartOfGroup:string,_Color:string>"
DOCUMENT = (f"Annotations struct<Annotation:array<{ANNOTATION}>>, AnnotationGroups struct<Group:array<{GROUP}>>")
ROOT = "ASAP_Annotations"


def parse_documents(docs: DataFrame, file: str = "file", text: str = "xml") -> DataFrame:
    return docs.select(F.col(file).alias("file"), F.from_xml(F.col(text), F.lit(DOCUMENT), {"mode": "FAILFAST"}).alias("d"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, xml): one row per file."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(S.stem(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("xml"))


def annotations_of(parsed: DataFrame) -> DataFrame:
    """(file, pos, name, type, group, color, coords): coordinates in their Order, decimal commas accepted, rounded
    half to even."""
    a = parsed.select("file", F.posexplode("d.Annotations.Annotation").alias("pos", "a"))

    def number(c):
        return F.rint(F.replace(c, F.lit(","), F.lit(".")).cast("double"))

    points = F.transform(F.array_sort(F.transform(
        F.col("a.Coordinates.Coordinate"), lambda p: F.struct(p["_Order"].alias("o"), number(p["_X"]).alias("x"),
                                                              number(p["_Y"]).alias("y")))),
        lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return a.select("file", "pos", F.col("a._Name").alias("name"), F.col("a._Type").alias("type"),
                    F.col("a._PartOfGroup").alias("group"), F.coalesce("a._Color", F.lit(ANNO_COLOR)).alias("color"),
                    points.alias("coords"))


def groups_of(parsed: DataFrame) -> DataFrame:
    """(file, pos, name, parent, color)."""
    g = parsed.select("file", F.posexplode("d.AnnotationGroups.Group").alias("pos", "g"))
    return g.select("file", "pos", F.col("g._Name").alias("name"), F.coalesce("g._PartOfGroup", F.lit("None")).alias("parent"),
                    F.coalesce("g._Color", F.lit(GROUP_COLOR)).alias("color"))


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(annotations, groups) of all files below a path."""
    parsed = parse_documents(read_documents(spark, path))
    return annotations_of(parsed), groups_of(parsed)


def to_documents(annos: DataFrame, groups: DataFrame, position: str = "pos") -> DataFrame:
    """(file, xml): one document per file. A document is one cell by nature, as is the file."""
    points = F.transform("coords", lambda p, i: F.struct(i.cast("int").alias("_Order"), p["x"].cast("string").alias("_X"),
                                                         p["y"].cast("string").alias("_Y")))
    a = F.struct(F.col("name").alias("_Name"), F.col("type").alias("_Type"),
                 F.coalesce("group", F.lit("None")).alias("_PartOfGroup"), F.col("color").alias("_Color"),
                 F.struct(points.alias("Coordinate")).alias("Coordinates"))
    g = F.struct(F.col("name").alias("_Name"), F.coalesce("parent", F.lit("None")).alias("_PartOfGroup"),
                 F.col("color").alias("_Color"))

    def packed(df: DataFrame, row, name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col("name").alias("n"), row.alias("r"))))
        return df.groupBy("file").agg(F.transform(items, lambda x: x["r"]).alias(name))

    both = packed(annos, a, "an").join(packed(groups, g, "gr"), "file", "full")
    doc = F.struct(F.struct(F.col("an").alias("Annotation")).alias("Annotations"),
                   F.struct(F.col("gr").alias("Group")).alias("AnnotationGroups"))
    return both.select("file", F.to_xml(doc, {"rowTag": ROOT}).alias("xml"))


def write_annotations(annos: DataFrame, groups: DataFrame, path: str, overwrite: bool = False, position: str = "pos") -> None:
    """One folder ``file=<name>`` with one XML text per annotated slide."""
    docs = to_documents(annos, groups, position)
    docs.select("file", "xml").repartition("file").write.mode("overwrite" if overwrite else "error").partitionBy("file").text(path)


def read_written(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read what :func:`write_annotations` wrote."""
    raw = spark.read.text(path, wholetext=True)
    parsed = parse_documents(raw.select(F.col("file").cast("string").alias("file"), F.col("value").alias("xml")))
    return annotations_of(parsed), groups_of(parsed)
