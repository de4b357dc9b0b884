"""Reading and writing cohort and result tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagframe.functions import scalars as S
from bagframe.operators.cohort import concat, nan_to_null, strip_columns
from bagframe.operators.spec import CohortSpec

# Short split names and their long forms.
SPLIT_NAMES = {"train": "training", "val": "validation", "valid": "validation", "test": "testing"}


def read_cohort_csv(spark: SparkSession, path: str, spec: CohortSpec, types: Mapping[str, str] | None = None) -> DataFrame:
    """Cohort CSV with a header. Everything is read as text and cast by ``types`` (targets default to INT for classes
    and DOUBLE otherwise); the name is always a string; a missing split column becomes 'default'."""
    df = strip_columns(spark.read.csv(path, header=True, inferSchema=False))
    number = "int" if spec.train_type.is_class_type else "double"
    types = {c: number for c in spec.target_cols} | dict(types or {})
    df = df.withColumns({c: F.col(c).cast("double").cast(t) if t == "int" else F.col(c).cast(t)
                         for c, t in types.items() if c in df.columns and c != spec.name_col})
    if spec.split_col not in df.columns:
        df = df.withColumn(spec.split_col, F.lit("default"))
    return nan_to_null(df)


def read_table_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Any CSV with a header; column names are stripped. Give a schema for large files: inference reads them twice."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return strip_columns(df)


YAML_ROW = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("split", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("image", T.StringType()), T.StructField("mask", T.StringType()),
    T.StructField("labels", T.ArrayType(T.DoubleType())), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])


def read_cohort_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, split, category, image, mask, labels, extra) from nested cohort files.

    A file has ``path: {key: folder}`` and ``data: {split: {category: [{image, mask?, labels, ...}]}}``; ``{key}`` in
    paths is replaced and the name is the stem of the image.
    """
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                doc = yaml.safe_load(bytes(content))
                folders = {"{%s}" % k: str(v) for k, v in (doc.get("path") or {}).items()}

                def place(p: str) -> str:
                    for k, v in folders.items():
                        p = p.replace(k, v)
                    return p

                rows = []
                for split, cats in doc["data"].items():
                    for cat, items in cats.items():
                        for item in items:
                            item = dict(item)
                            image, mask, labels = item.pop("image"), item.pop("mask", None), item.pop("labels")
                            labels = labels if isinstance(labels, list) else [labels]
                            rows.append((file, SPLIT_NAMES.get(split, split), str(cat), place(image),
                                         place(mask) if mask else None, [float(v) for v in labels],
                                         {str(k): str(v) for k, v in item.items()}))
                yield pd.DataFrame(rows, columns=YAML_ROW.names)

    df = raw.mapInPandas(parse, YAML_ROW)
    return df.select("file", S.stem("image").alias("name"), *YAML_ROW.names[1:])


def read_cohort(spark: SparkSession, path: str, spec: CohortSpec, **options) -> DataFrame:
    """By suffix: csv or yaml. A yaml cohort gets one-hot target columns from its label lists."""
    if path.endswith("csv"):
        return read_cohort_csv(spark, path, spec, **options)
    if path.endswith(("yaml", "yml")):
        df = read_cohort_yaml(spark, path)
        if spec.train_type.is_class_type:
            return df.withColumns({c: F.array_contains("labels", F.lit(float(k))).cast("int")
                                   for k, c in enumerate(spec.target_cols)}).drop("labels")
        return df.withColumns({c: F.col("labels")[k] for k, c in enumerate(spec.target_cols)}).drop("labels")
    raise ValueError(f"unknown suffix of {path}")


def write_cohort(df: DataFrame, path: str, spec: CohortSpec, cols: Sequence[str] | None = None, drop_label: bool = False,
                 overwrite: bool = False, single_file: bool = False) -> None:
    """CSV sorted by name. ``single_file`` is for small exports only."""
    if drop_label:
        df = df.drop(spec.label_col)
    if cols is not None:
        df = df.select(*cols)
    order = [spec.name_col] if spec.name_col in df.columns else []
    out = df.coalesce(1).sortWithinPartitions(*order) if single_file and order else df.orderBy(*order) if order else df
    out.write.mode("overwrite" if overwrite else "error").csv(path, header=True)


def save_table(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "parquet",
               partition_by: Sequence[str] = ()) -> None:
    """Refuses to replace an existing table unless told to."""
    w = df.write.mode("overwrite" if overwrite else "error").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def save_metrics_json(metrics: DataFrame, path: str, keys: Sequence[str], overwrite: bool = False) -> None:
    """One JSON document per key from a long metrics table (keys..., metric, value)."""
    docs = metrics.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    docs.select(F.to_json(F.struct(*keys, "metrics")).alias("value")).write.mode(
        "overwrite" if overwrite else "error").text(path)


def split_files(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """(split, slide, label) for the three-file exchange format; the last target is the binary label."""
    if spec.n_classes > 2:
        raise ValueError("only binary cohorts have this format")
    return df.where(F.col(spec.split_col).isin("training", "validation", "testing")).select(
        F.col(spec.split_col).alias("split"), F.col(spec.name_col).alias("slide"),
        F.col(spec.target_cols[-1]).alias("label"))


def write_split_files(df: DataFrame, path: str, spec: CohortSpec, overwrite: bool = False) -> None:
    save_table(split_files(df, spec), path, overwrite, "csv", ["split"])


def from_split_files(tables: Mapping[str, DataFrame], classes: Sequence[str], label: str = "label",
                     image_dir: str | None = None) -> DataFrame:
    """One cohort from per-split tables {split: table}: a column named train/val/test is the name, '.tif' is removed,
    classes become one-hot columns."""
    parts = []
    for split, t in tables.items():
        for old in ("train", "val", "test"):
            if old in t.columns:
                t = t.withColumnRenamed(old, "name")
        parts.append(t.withColumns({"split": F.lit(split), "name": F.replace(F.col("name"), F.lit(".tif"), F.lit(""))}))
    df = concat(*parts)
    if image_dir is not None:
        df = df.withColumn("image", F.concat(F.lit(image_dir + "/"), F.col("name"), F.lit(".tif")))
    lab = F.col(label).cast("int")
    return df.withColumns({label: lab} | {c: (lab == k).cast("int") for k, c in enumerate(classes)})


