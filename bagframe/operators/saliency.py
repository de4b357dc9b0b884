"""Attention maps of slides as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagframe.functions import labels as L
from bagframe.functions.stats import ratio
from bagframe.operators.bags import top_k
from bagframe.operators.hot import attach_table, with_stats
from bagframe.operators.spec import CohortSpec

MAP = ("name", "cls")


def _uint8(c):
    """Truncated to 0..255; missing values are 0."""
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(255), c.cast("int"))), F.lit(0))


def attention_map(att: DataFrame, operation: str | None = "scale", value: str = "a_raw", group: Sequence[str] = MAP) -> DataFrame:
    """Add ``level`` 0..255 per cell.

    scale: minus the smallest finite value, divided by the largest result; softmax: over the classes of a cell; sigm:
    sigmoid; tiles: softmax over all cells of a map; None: the value itself.
    """
    v, group = F.col(value), list(group)
    finite = F.abs(v) < float("inf")
    if operation == "scale":
        x = with_stats(att, group, __lo=F.min(F.when(finite, v)), __hi=F.max(v))
        span = F.col("__hi") - F.col("__lo")
        scaled = F.when(finite, F.when(span != 0, (v - F.col("__lo")) / span).otherwise(v - F.col("__lo"))).otherwise(0.0)
        return x.withColumn("level", _uint8(scaled * 255)).drop("__lo", "__hi")
    if operation in ("softmax", "tiles"):
        keys = [c for c in (*group, "i", "j") if c != "cls"] if operation == "softmax" else group
        x = with_stats(att, keys, __hi=F.max(v)).withColumn("__e", F.when(finite, F.exp(v - F.col("__hi"))).otherwise(0.0))
        x = with_stats(x, keys, __t=F.sum("__e"))
        return x.withColumn("level", _uint8(ratio(F.col("__e"), F.col("__t")) * 255)).drop("__hi", "__e", "__t")
    if operation == "sigm":
        return att.withColumn("level", _uint8(L.sigmoid(v) * 255))
    if operation is None:
        return att.withColumn("level", _uint8(v * 255))
    raise ValueError(f"unknown map operation {operation}")


def map_spacing(spacing: float, stride: int) -> float:
    """Spacing of an output map with one pixel per tile."""
    return spacing * stride


def upscale(att: DataFrame, factor: int, shapes: DataFrame | None = None, value: str = "level") -> DataFrame:
    """Nearest-neighbour enlargement: every cell becomes factor x factor cells, cropped to the slide (name, h, w)."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    keys = [c for c in att.columns if c not in ("i", "j", value)]
    x = att.select(*keys, "i", "j", value).withColumn("__r", F.explode(steps)).withColumn("__c", F.explode(steps))
    x = x.select(*keys, (F.col("i") * factor + F.col("__r")).alias("i"), (F.col("j") * factor + F.col("__c")).alias("j"), value)
    if shapes is not None:
        s = shapes.select("name", F.col("h").alias("__h"), F.col("w").alias("__w"))
        x = attach_table(x, s, ["name"]).where((F.col("i") < F.col("__h")) & (F.col("j") < F.col("__w"))).drop("__h", "__w")
    return x


def salient_tiles(att: DataFrame, stride: int, n: int = 9, value: str = "a_raw", group: Sequence[str] = MAP,
                  second: str | None = None) -> DataFrame:
    """The n most salient tiles of every map with slide coordinates and the score as text."""
    best = top_k(att.where(F.col(value) > float("-inf")), value, n, group)
    text = F.format_string("%.4f", F.col(value))
    if second is not None:
        text = F.concat(text, F.lit(" ("), F.format_string("%.4f", F.col(second)), F.lit(")"))
    return best.select(*group, "rank", "i", "j", (F.col("j") * stride).alias("x"), (F.col("i") * stride).alias("y"),
                       value, text.alias("score"))


def slides_to_map(predictions: DataFrame, spec: CohortSpec, n_correct: int = 50, n_wrong: int = 50,
                  splits: Sequence[str] | None = None) -> DataFrame:
    """Which slides get a map: up to n_correct right and n_wrong wrong ones per highest true label, by name, with the
    true-predicted link name. Targets and pred columns are one-hot."""
    x = predictions if splits is None else predictions.where(F.col(spec.split_col).isin(list(splits)))
    true = L.label_indices(spec.target_cols)
    pred = L.label_indices([f"{spec.pred_prefix}{i}" for i in range(spec.n_classes)])
    x = x.withColumns({"top_label": F.array_max(true), "correct": true == pred,
                       "link": L.link_name(true, pred, spec.target_cols)})
    w = Window.partitionBy("top_label", "correct").orderBy(spec.name_col)
    x = x.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max(n_correct, n_wrong))
    cap = F.when(F.col("correct"), n_correct).otherwise(n_wrong)
    return x.where(F.col("__n") <= cap).select(spec.name_col, "top_label", "correct", "link")
