"""Prediction tables and ensembles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagframe.functions import labels as L
from bagframe.operators.profile import joined_text, unique_one
from bagframe.operators.spec import CohortSpec, TrainType


def add_scores(df: DataFrame, spec: CohortSpec, logits: Sequence[str]) -> DataFrame:
    """Add out0.. from logits with the train type's output function."""
    k = len(logits)
    x = df.withColumn("__o", L.post_process(logits, spec.train_type.post_function, k))
    return x.withColumns({f"{spec.out_prefix}{i}": F.col("__o")[i] for i in range(k)}).drop("__o")


def add_predictions(df: DataFrame, spec: CohortSpec, labels: str | None = None) -> DataFrame:
    """Add one-hot pred0.. (from a label column, else from the scores), ``pred_wrong`` when any class differs, and
    ``pred_diff``, the mean absolute difference of targets and scores."""
    k = spec.n_classes
    if labels is not None:
        hot = {f"{spec.pred_prefix}{i}": (F.col(labels) == i).cast("int") for i in range(k)}
    elif spec.train_type is TrainType.CLF:
        hot = {f"{spec.pred_prefix}{i}": (L.argmax(spec.out_cols) == i).cast("int") for i in range(k)}
    elif spec.train_type is TrainType.MULTILABEL:
        hot = {f"{spec.pred_prefix}{i}": (F.col(o) >= 0.5).cast("int") for i, o in enumerate(spec.out_cols)}
    else:
        hot = {f"{spec.pred_prefix}{i}": F.col(o) for i, o in enumerate(spec.out_cols)}
    x = df.withColumns(hot)
    if spec.train_type.is_class_type:
        wrong = reduce(lambda a, b: a | b, [F.col(t) != F.col(f"{spec.pred_prefix}{i}")
                                            for i, t in enumerate(spec.target_cols)])
        x = x.withColumn("pred_wrong", wrong.cast("int"))
    if spec.train_type is not TrainType.SURV:
        diff = reduce(lambda a, b: a + b, [F.abs(F.col(t) - F.col(o)) for t, o in zip(spec.target_cols, spec.out_cols)])
        x = x.withColumn("pred_diff", diff / float(k))
    return x


def ensemble_predictions(members: DataFrame, id_col: str = "name", drop: Sequence[str] = ("path", "image", "member"),
                         n_members: int | None = None) -> DataFrame:
    """One row per id from the stacked tables of several models.

    Columns starting with out, pred or logit become mean and sample standard deviation (``_std``); every other column
    must have a single value per id. With ``n_members``, an id with another number of rows is an error.
    """
    cols = [c for c in members.columns if c not in drop and c != id_col]
    scores = [c for c in cols if c.startswith(("out", "pred", "logit"))]
    aggs = [unique_one(c).alias(c) for c in cols if c not in scores]
    for c in scores:
        aggs += [F.avg(c).alias(c), F.stddev_samp(c).alias(f"{c}_std")]
    if n_members is not None:
        n = F.count(F.lit(1))
        bad = F.raise_error(F.concat(F.lit(f"an id does not have {n_members} members: "), F.first(id_col)))
        aggs.append(F.when(n != n_members, bad.cast("long")).otherwise(n).alias("__n"))
        return members.groupBy(id_col).agg(*aggs).where(F.col("__n") > 0).drop("__n")
    return members.groupBy(id_col).agg(*aggs)


def ensemble_attention(att: DataFrame, keys: Sequence[str] = ("name", "cls", "i", "j"), value: str = "a_raw",
                       member: str = "member") -> DataFrame:
    """Mean and population standard deviation of attention cells over models. Every name must have the same number
    (at least 2) of members."""
    members = att.groupBy("name").agg(F.count_distinct(member).alias("m")).agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    ok = members.select((F.col("lo") == F.col("hi")) & (F.col("lo") >= 2)).scalar()
    x = att.groupBy(*keys).agg(F.avg(value).alias(value), F.stddev_pop(value).alias(f"{value}_std"))
    error = F.raise_error(F.lit("names need the same number (at least 2) of ensemble members")).cast("double")
    return x.withColumn(value, F.when(ok, F.col(value)).otherwise(error))


def aggregate_records(df: DataFrame, group: Sequence[str], ignore: Sequence[str] = (), number_unique: bool = False,
                      text_unique: bool = False) -> DataFrame:
    """Merge the records of a group by column type: numbers to mean and population std (or the single value), texts to
    ``;``-joined text (or the single value), arrays of numbers elementwise to mean and std, others to a list."""
    aggs: list[Column] = []
    arrays: list[str] = []
    for f in df.schema.fields:
        c, t = f.name, f.dataType
        if c in group or c in ignore:
            continue
        if isinstance(t, T.NumericType):
            aggs += [unique_one(c).alias(c)] if number_unique else [
                F.avg(c).alias(c), F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_std")]
        elif isinstance(t, T.StringType):
            aggs.append((unique_one(c) if text_unique else joined_text(c, ";")).alias(c))
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.NumericType):
            arrays.append(c)
        else:
            aggs.append(F.collect_list(c).alias(c))
    out = df.groupBy(*group).agg(*aggs) if aggs else df.select(*group).distinct()
    for c in arrays:
        cells = df.select(*group, F.posexplode(c).alias("__pos", "__v")).groupBy(*group, "__pos").agg(
            F.avg("__v").alias("m"), F.stddev_pop("__v").alias("s"))
        packed = cells.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__pos", "m", "s"))).alias("__a")).select(
            *group, F.col("__a.m").alias(c), F.col("__a.s").alias(f"{c}_std"))
        out = out.join(packed, list(group))
    return out


def sum_maps(df: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """Key-wise sums of a MAP column: (group..., key, value)."""
    return df.select(*group, F.explode(col).alias("key", "value")).groupBy(*group, "key").agg(F.sum("value").alias("value"))


def targets_from_text(df: DataFrame, target: str, n_targets: int, prefix: str = "target") -> DataFrame:
    """Older prediction tables: one-hot ``target0..`` from a scalar or list text such as ``1`` or ``[0,2]``. An
    existing column that disagrees is an error."""
    idx = F.transform(F.split(F.regexp_replace(F.col(target).cast("string"), "[\\[\\]\\s]", ""), ","),
                      lambda v: v.try_cast("int"))
    cols = {}
    for k in range(n_targets):
        c = f"{prefix}{k}"
        hot = F.array_contains(idx, F.lit(k)).cast("int")
        if c in df.columns:
            hot = F.when(F.col(c) != hot, F.raise_error(F.lit(f"different targets in {c}")).cast("int")).otherwise(hot)
        cols[c] = hot
    return df.withColumns(cols)


def single_target(target: str) -> Column:
    """The only element of a scalar or one-element list text; longer lists are NULL."""
    parts = F.split(F.regexp_replace(F.col(target).cast("string"), "[\\[\\]\\s]", ""), ",")
    return F.when(F.size(parts) == 1, parts[0].try_cast("int"))
