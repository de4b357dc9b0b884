"""Cohort summaries, value counts, group checks and group aggregates.

Checks that look like windows (`count() over (partition by key)`) are written as aggregate + semi join: the aggregate
combines map-side, so a key that holds a third of the rows never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagframe.functions import labels as L
from bagframe.functions.stats import ratio
from bagframe.operators.cohort import select_split
from bagframe.operators.hot import keep_keys
from bagframe.operators.spec import CohortSpec, TrainType


def label_counts(df: DataFrame, spec: CohortSpec, group: Sequence[str] = ()) -> DataFrame:
    """(group..., label, n): rows per argmax label (clf) or sum of every label column (multilabel)."""
    if spec.train_type is TrainType.CLF:
        return df.groupBy(*group, L.argmax(spec.target_cols).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    if spec.train_type is TrainType.MULTILABEL:
        sums = df.groupBy(*group).agg(*[F.sum(F.col(c).cast("long")).alias(f"__s{i}")
                                        for i, c in enumerate(spec.target_cols)])
        pairs = F.array(*[F.struct(F.lit(i).cast("int").alias("label"), F.col(f"__s{i}").alias("n"))
                          for i in range(spec.n_classes)])
        return sums.select(*group, F.explode(pairs).alias("p")).select(*group, "p.label", "p.n")
    raise ValueError(f"no classes for type {spec.train_type}")


def label_ratios(df: DataFrame, spec: CohortSpec, split=None) -> DataFrame:
    """(label, n, ratio). The multilabel ratio is relative to the sum of all label counts, not to the rows."""
    c = label_counts(select_split(df, spec, split), spec)
    total = c.agg(F.sum("n")).scalar()
    return c.withColumn("ratio", ratio(F.col("n"), total))


def category_ratios(df: DataFrame, spec: CohortSpec, split=None, level: str | int = "") -> DataFrame:
    col = spec.category(level)
    c = select_split(df, spec, split).groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("ratio", ratio(F.col("n"), c.agg(F.sum("n")).scalar()))


def split_counts(df: DataFrame, spec: CohortSpec, split: str | None = None) -> DataFrame:
    c = df.groupBy(spec.split_col).agg(F.count(F.lit(1)).alias("n"))
    return c if split is None else c.where(F.col(spec.split_col) == split)


def cohort_summary(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """(split, category, labels, n, ratio) for split; category; split x category; split x category x label. A column
    that is rolled up says 'all'. One grouping-sets aggregate."""
    s, c, lab = spec.split_col, spec.category_col, "labels"
    clf = spec.train_type is TrainType.CLF
    x = df.withColumn(lab, L.argmax(spec.target_cols).cast("string") if clf else F.lit("all"))
    sets = [[s], [c], [s, c]] + ([[s, c, lab]] if clf else [])
    cols = [s, c, lab] if clf else [s, c]
    g = x.groupingSets([[F.col(k) for k in ks] for ks in sets], *cols)
    agg = g.agg(F.count(F.lit(1)).alias("n"), *[F.grouping(k).alias(f"__g_{k}") for k in cols])
    shown = [F.when(F.col(f"__g_{k}") == 1, F.lit("all")).otherwise(F.col(k)).alias(k) for k in cols]
    if not clf:
        shown.append(F.lit("all").alias(lab))
    total = df.agg(F.count(F.lit(1))).scalar()
    return agg.select(*shown, "n", ratio(F.col("n"), total).alias("ratio"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def categories(df: DataFrame, spec: CohortSpec, level: str | int = "") -> DataFrame:
    """(category, rank): sorted categories of a level, or the given order of the first level, which must be the same set."""
    found = df.select(F.col(spec.category(level)).alias("category")).distinct()
    if not (spec.categories_order and str(level) == ""):
        return found.withColumn("rank", (F.row_number().over(Window.orderBy("category")) - 1).cast("long"))   # one row per category
    order = list(spec.categories_order)
    given = df.sparkSession.createDataFrame(list(zip(order, range(len(order)))), "category string, rank long")
    both = found.withColumn("__found", F.lit(True)).join(given, found["category"].eqNullSafe(given["category"]), "full_outer")
    bad = F.raise_error(F.concat(F.lit("a category that is not in both the table and the given order: "),
                                 F.coalesce(found["category"], given["category"], F.lit("null")))).cast("long")
    return both.select(given["category"], F.when(F.col("__found") & F.col("rank").isNotNull(), F.col("rank")).otherwise(bad).alias("rank"))


def target_values(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """Distinct class indices that occur (classes) or distinct target values (otherwise), sorted."""
    if spec.train_type.is_class_type:
        return df.select(F.explode(L.label_indices(spec.target_cols)).alias("value")).distinct().orderBy("value")
    vals = F.array(*[F.col(c).cast("double") for c in spec.target_cols])
    return df.select(F.explode(vals).alias("value")).distinct().orderBy("value")


def _long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).select("p.col", "p.val")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col, val, count); missing values are counted as their own NULL value."""
    return _long_values(df, cols).groupBy("col", "val").agg(F.count(F.lit(1)).alias("count"))


def value_count_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows are the union of values, columns the given columns, with a ``col_sum`` row and a ``row_sum`` column."""
    long = _long_values(df, cols)
    counts = [F.count_if(F.col("col") == c).alias(c) for c in cols]
    m = long.rollup("val").agg(*counts, F.grouping("val").alias("__g"))
    value = F.when(F.col("__g") == 1, F.lit("col_sum")).otherwise(F.col("val"))
    return m.select(value.alias("value"), *cols, reduce(lambda a, b: a + b, [F.col(c) for c in cols]).alias("row_sum"))


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(var, mean, min, max, std) per column; std is the sample one."""
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.struct(F.lit(c).alias("var"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
                          F.stddev_samp(v).alias("std")).alias(f"__{i}")]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"__{i}") for i in range(len(cols))])).alias("s")).select("s.*")


def group_mode(df: DataFrame, group: Sequence[str], value: str, highest: bool = False) -> DataFrame:
    """(group..., value, n): the most frequent value, the lowest (or highest) one on a tie."""
    c = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    if highest:
        best = F.max(F.struct(F.col("n").alias("k"), F.col(value).alias("v")))
        n = F.col("b.k")
    else:
        best = F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v")))
        n = -F.col("b.k")
    return c.groupBy(*group).agg(best.alias("b")).select(*group, F.col("b.v").alias(value), n.alias("n"))


def duplicates(df: DataFrame, key: str, error: bool = False) -> DataFrame:
    """All copies of every key that occurs more than once; missing keys are ignored."""
    twice = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    if error:
        bad = twice.limit(1).collect()
        if bad:
            raise ValueError(f"duplicates of {key}: {bad[0][0]}")
    return keep_keys(df, twice, [key])


def unique_one(col: str | Column, allow_null: bool = True, name: str | None = None) -> Column:
    """Aggregate: the only non-null value of a group; two different values are an error. From min and max only."""
    c = F.col(col) if isinstance(col, str) else col
    name = name or (col if isinstance(col, str) else "value")
    bad = F.min(c) != F.max(c)
    if not allow_null:
        bad = bad | (F.count_if(c.isNull()) > 0)
    return F.when(bad, F.raise_error(F.lit(f"more than one value (or a missing one) of {name} in a group"))
                  ).otherwise(F.max(c))


def joined_text(col: str, separator: str = ", ", unique: bool = False) -> Column:
    """Aggregate: values of a group as sorted text, NULLs left out; NULL when there are none."""
    c = f"cast(`{col}` as string)"
    sep = separator.replace("'", "\\'")
    distinct = "distinct " if unique else ""
    return F.expr(f"listagg({distinct}{c}, '{sep}') within group (order by {c})")


def inconsistent_groups(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """For every ordered pair of id columns, all rows of g1 groups that have more than one g2 value."""
    out = []
    for g1 in ids:
        for g2 in ids:
            if g1 == g2:
                continue
            bad = df.groupBy(g1).agg(F.min(g2).alias("__a"), F.max(g2).alias("__b")).where("__a <> __b").select(g1)
            out.append(keep_keys(df, bad, [g1]).select(F.lit(g1).alias("group_col"), F.lit(g2).alias("other_col"),
                                                            *df.columns))
    return reduce(lambda a, b: a.unionByName(b), out)


def cooccurrence(df: DataFrame, variables: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """(var, one column per variable): the matrix X'X of 0/1 columns in one aggregate pass."""
    names = list(order or variables)
    sums = df.agg(*[F.sum((F.col(a) * F.col(b)).cast("long")).alias(f"__{i}_{j}")
                    for i, a in enumerate(names) for j, b in enumerate(names) if i <= j])
    rows = [F.struct(F.lit(a).alias("var"), *[F.col(f"__{min(i, j)}_{max(i, j)}").alias(b) for j, b in enumerate(names)])
            for i, a in enumerate(names)]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def run_status(report: DataFrame) -> DataFrame:
    """(n, n_ok, n_existed, n_error, all_ok): totals of a run report; an empty report is ok."""
    ok = F.coalesce(F.col("ok"), F.lit(False)) | F.coalesce(F.col("existed"), F.lit(False))
    return report.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ok")).alias("n_ok"),
                      F.count_if(F.col("existed")).alias("n_existed"),
                      F.count_if(F.col("error").isNotNull()).alias("n_error"),
                      F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_ok"))


def slide_totals(slides: DataFrame, flags: Sequence[str] = ()) -> DataFrame:
    """n, file size min/max/sum, area min/max with the shapes there, and how many slides have each spacing."""
    return slides.agg(
        F.count(F.lit(1)).alias("n"), F.min("filesize").alias("filesize_min"), F.max("filesize").alias("filesize_max"),
        F.sum("filesize").alias("filesize_sum"), F.min("area").alias("area_min"), F.max("area").alias("area_max"),
        F.min(F.struct("area", "name", "shape"))["shape"].alias("shape_min"),
        F.max(F.struct("area", "name", "shape"))["shape"].alias("shape_max"),
        *[F.count_if(F.col(f)).alias(f.replace("has", "n", 1)) for f in flags])


def directory_sizes(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    parent = F.regexp_replace(F.col(path), "/[^/]*$", "")
    return files.groupBy(parent.alias("directory")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))


def mean_of_metrics(cols: Sequence[str]) -> Column:
    """Mean of several metrics when all are present, else NULL."""
    return reduce(lambda a, b: a + b, [F.col(c).cast("double") for c in cols]) / float(len(cols))


def window_share(value: str, group: Sequence[str]) -> Column:
    """Share of a value in its (small, already aggregated) group."""
    return ratio(F.col(value), F.sum(value).over(Window.partitionBy(*group)))
