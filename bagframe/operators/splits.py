"""Cross-validation splits as tables.

A fold number is the position of an id in md5 order of (seed, id) inside its stratum, plus a running offset between
strata, modulo k. The guarantees are those of a stratified, grouped, shuffled k-fold: all rows of an id share a fold,
every stratum is spread evenly, and fold sizes differ by at most one overall. Nothing is random, so a recomputed task
gives the same folds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagframe.functions import labels as L
from bagframe.functions.stats import hoyer
from bagframe.operators.hot import COUNT, attach, attach_table
from bagframe.operators.scan import hash_position
from bagframe.operators.spec import CohortSpec, TrainType


def split_label(spec: CohortSpec) -> Column:
    """The label folds are balanced on: class index, or the worst class of a multilabel row."""
    if spec.train_type is TrainType.CLF:
        return L.argmax(spec.target_cols)
    if spec.train_type is TrainType.MULTILABEL:
        return L.worst_label(spec.target_cols)
    raise ValueError("splits need a classification cohort")


def id_labels(df: DataFrame, spec: CohortSpec, id_col: str, keep: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """One row per (keep..., id) with the label (and extra columns) of its first row by name."""
    first = F.min_by(F.struct(split_label(spec).alias("label"), *extra), F.col(spec.name_col))
    return df.groupBy(*keep, id_col).agg(first.alias("__f")).select(
        *keep, id_col, F.col("__f.label").alias("label"), *[F.col("__f")[c].alias(c) for c in extra])


def assign_folds(ids: DataFrame, id_col: str, k: int, strata: Sequence[str] = ("label",), within: Sequence[str] = (),
                 seed: int = 1, salt: Sequence[Column | str] = (), blocks: int | None = None) -> DataFrame:
    """Add ``fold`` in 0..k-1. ``within`` columns are split independently (categories, seeds, outer folds)."""
    strata, within = list(strata), list(within)
    group = [*within, *strata]
    placed = hash_position(ids, group, [id_col], [F.lit(str(seed)), *salt], blocks=blocks)
    if strata:
        sizes = ids.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
        before = Window.partitionBy(*within).orderBy(*strata).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(*group, F.col("__n").alias(COUNT), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
        placed = attach(placed, offsets, group)
    else:
        placed = placed.withColumn("__off", F.lit(0))
    return placed.select(*ids.columns, ((F.col("pos") + F.col("__off")) % k).cast("int").alias("fold"))


def cv_folds(df: DataFrame, spec: CohortSpec, k: int = 5, id_col: str | None = None, stratified: bool = True,
             within: Sequence[str] = (), seed: int = 1) -> DataFrame:
    """The cohort with a ``fold`` column: the fold in which a row is validated."""
    id_col = id_col or spec.name_col
    ids = id_labels(df, spec, id_col, within)
    folds = assign_folds(ids, id_col, k, ["label"] if stratified else [], within, seed)
    return attach_table(df, folds.select(*within, id_col, "fold"), [*within, id_col])


def fold_tables(folds: DataFrame, k: int, spec: CohortSpec, train: str = "training", val: str = "validation",
                fold_col: str = "fold") -> DataFrame:
    """Long form of the k tables: ``fold`` is the table number, rows of that fold get ``val``, the others ``train``."""
    x = folds.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    split = F.when(F.col(fold_col) == F.col("__t"), val).otherwise(train)
    return x.withColumn(spec.split_col, split).withColumn(fold_col, F.col("__t").cast("int")).drop("__t")


def rotating_tables(folds: DataFrame, k: int, spec: CohortSpec, train: str = "training", val: str = "validation",
                    test: str = "testing") -> DataFrame:
    """Train/validation/test rotation: table i tests fold i and validates fold i+1 (the last one validates fold 0)."""
    x = folds.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    split = F.when(F.col("fold") == F.col("__t"), test).when(
        F.col("fold") == (F.col("__t") + 1) % k, val).otherwise(train)
    return x.withColumn(spec.split_col, split).withColumn("fold", F.col("__t").cast("int")).drop("__t")


def nested_folds(df: DataFrame, spec: CohortSpec, k: int = 5, id_col: str | None = None, stratified: bool = True,
                 seed: int = 1, train: str = "training", val: str = "validation", test: str = "testing") -> DataFrame:
    """Nested cross-validation in long form: (outer, inner, split) per row, named ``fold{outer}_fold{inner}``.

    For every outer fold the remaining ids are split again, with a hash salted by the outer fold; the outer fold's
    own ids are the test rows of all its inner tables.
    """
    id_col = id_col or spec.name_col
    strata = ["label"] if stratified else []
    ids = id_labels(df, spec, id_col)
    outer = assign_folds(ids, id_col, k, strata, seed=seed).withColumnRenamed("fold", "__of")
    per_outer = outer.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    inner = assign_folds(per_outer.where(F.col("__of") != F.col("outer")), id_col, k, strata, ["outer"], seed,
                         [F.col("outer").cast("string")])
    tables = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    trained = inner.withColumn("inner", tables).select(
        id_col, "outer", "inner", F.when(F.col("fold") == F.col("inner"), val).otherwise(train).alias("__s"))
    tested = per_outer.where(F.col("__of") == F.col("outer")).withColumn("inner", tables).select(
        id_col, "outer", "inner", F.lit(test).alias("__s"))
    both = trained.unionByName(tested)
    return df.drop(spec.split_col).join(both, id_col).withColumnRenamed("__s", spec.split_col).withColumn(
        "table", F.format_string("fold%d_fold%d", F.col("outer"), F.col("inner")))


def balanced_folds(df: DataFrame, spec: CohortSpec, balance_cols: Sequence[str], k: int = 5, iterations: int = 100,
                   id_col: str | None = None, stratified: bool = True, seed: int = 1) -> DataFrame:
    """The splitting, out of ``iterations``, whose test folds have the smallest mean Hoyer sparseness of the balance
    columns (missing values left out, ties go to the later one). All candidates are evaluated in one plan: the seed is
    a column of the id table."""
    id_col = id_col or spec.name_col
    ids = id_labels(df, spec, id_col, extra=balance_cols)
    seeds = F.explode(F.sequence(F.lit(seed), F.lit(seed + iterations - 1)))
    tried = assign_folds(ids.withColumn("__seed", seeds), id_col, k, ["label"] if stratified else [], ["__seed"], seed,
                         [F.col("__seed").cast("string")])
    per_fold = tried.groupBy("__seed", "fold").agg(*[hoyer(c).alias(c) for c in balance_cols])
    total = sum((F.col(c) for c in balance_cols), F.lit(0.0)) / float(len(balance_cols))
    score = per_fold.groupBy("__seed").agg(
        F.when(F.count(total) == F.count(F.lit(1)), F.round(F.avg(total), 12)).alias("balance"))
    best = score.agg(F.max(F.when(F.col("balance").isNotNull(), F.struct(-F.col("balance"), F.col("__seed"))))["__seed"])
    chosen = tried.where(F.col("__seed") == best.scalar())
    return attach_table(df, chosen.select(id_col, "fold"), [id_col])


def fold_violations(tables: DataFrame, spec: CohortSpec, k: int, id_col: str | None = None, val: str = "validation",
                    test: str | None = None, train: str = "training") -> DataFrame:
    """Ids that break the rules: validated (and tested, if ``test`` is given) exactly once, and trained in the table
    before the one that validates them. Empty when the splits are sound."""
    id_col = id_col or spec.name_col
    per = tables.select(id_col, "fold", spec.split_col).distinct()
    s = F.col(spec.split_col)
    a = per.groupBy(id_col).agg(
        F.count_if(s == val).alias("n_val"), F.count_if(s == (test or "")).alias("n_test"),
        F.max(F.when(s == val, F.col("fold"))).alias("__v"),
        F.collect_list(F.when(s == train, F.col("fold"))).alias("__train"))
    bad = F.col("n_val") != 1
    if test is not None:
        bad = bad | (F.col("n_test") != 1)
    else:
        bad = bad | ((F.col("__v") > 0) & ~F.array_contains("__train", F.col("__v") - 1))
    return a.where(bad).select(id_col, "n_val", "n_test")
