"""Equi-joins with the checks cohort work needs.

No join carries a broadcast hint: Spark broadcasts a side only when its size, estimated or measured by AQE, is below
``spark.sql.autoBroadcastJoinThreshold``, and splits skewed partitions of the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagframe.operators.cohort import concat
from bagframe.operators.hot import keep_keys
from bagframe.operators.spec import CohortSpec


def merge(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None, check: str | None = None,
          left_title: str = "x", right_title: str = "y", how: str = "inner") -> DataFrame:
    """Equi-join; clashing non-key columns get ``_<title>`` suffixes.

    ``check`` in left/right/both compares the merged row count with that side. The check is one eager job over the
    key columns only.
    """
    right_on = right_on or left_on
    shared = {c for c in left.columns if c in right.columns} - ({left_on} if left_on == right_on else set())
    lo = left.select(*[F.col(c).alias(f"{c}_{left_title}" if c in shared else c) for c in left.columns])
    ro = right.select(*[F.col(c).alias("__rk" if c == right_on and left_on == right_on else
                                       f"{c}_{right_title}" if c in shared else c) for c in right.columns])
    lk = f"{left_on}_{left_title}" if left_on in shared else left_on
    rk = "__rk" if left_on == right_on else f"{right_on}_{right_title}" if right_on in shared else right_on
    if check:
        n = merge_counts(left, right, left_on, right_on).first()
        for side in ("left", "right"):
            if check in (side, "both") and n["merged"] != n[side]:
                raise ValueError(f"merge of {n['left']} with {n['right']} rows gives {n['merged']}")
    return lo.join(ro, F.col(lk) == F.col(rk), how).drop("__rk")


def merge_counts(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None) -> DataFrame:
    """One row: left, right, merged, left_only, right_only row counts of an inner join, from per-key counts."""
    right_on = right_on or left_on
    lc = left.groupBy(F.col(left_on).alias("k")).agg(F.count(F.lit(1)).alias("l"))
    rc = right.groupBy(F.col(right_on).alias("k2")).agg(F.count(F.lit(1)).alias("r"))
    j = lc.join(rc, F.col("k") == F.col("k2"), "full")
    z = F.lit(0)
    l, r = F.coalesce("l", z), F.coalesce("r", z)
    return j.agg(F.coalesce(F.sum(l), z).alias("left"), F.coalesce(F.sum(r), z).alias("right"),
                 F.coalesce(F.sum(l * r), z).alias("merged"),
                 F.coalesce(F.sum(F.when(r == 0, l)), z).alias("left_only"),
                 F.coalesce(F.sum(F.when(l == 0, r)), z).alias("right_only"))


def merge_check(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None,
                left_title: str = "x", right_title: str = "y") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged, rows only in left, rows only in right)."""
    right_on = right_on or left_on
    lk, rk = left.select(F.col(left_on).alias("__k")), right.select(F.col(right_on).alias("__k"))
    return (merge(left, right, left_on, right_on, None, left_title, right_title),
            left.join(rk, F.col(left_on) == F.col("__k"), "left_anti"),
            right.join(lk, F.col(right_on) == F.col("__k"), "left_anti"))


def strict_merge(cohort: DataFrame, other: DataFrame, spec: CohortSpec, key: str | None = None,
                 validate: bool = True) -> DataFrame:
    """Cohort joined to a table by name. A clash of any other column is an error at plan time; the result must keep
    the cohort's row count (checked by one job over the keys unless ``validate`` is off)."""
    key = key or spec.name_col
    clash = sorted((set(cohort.columns) & set(other.columns)) - {spec.name_col, key})
    if clash:
        raise ValueError(f"duplicate columns in both tables: {clash}")
    other = other.withColumn(key, F.col(key).cast("string"))
    if validate:
        n = merge_counts(cohort, other, spec.name_col, key).first()
        if n["merged"] != n["left"]:
            raise ValueError(f"{n['left']} rows in the cohort, but {n['merged']} after merging")
    return cohort.join(other.withColumnRenamed(key, spec.name_col), spec.name_col)


def attach_paths(cohort: DataFrame, spec: CohortSpec, *path_tables: DataFrame, column: str = "image",
                 validate: bool = True) -> DataFrame:
    """Set the image column from (name, path) tables, replacing an existing one."""
    paths = concat(*path_tables).select("name", F.col("path").alias(column))
    return strict_merge(cohort.drop(column), paths.withColumnRenamed("name", spec.name_col), spec, validate=validate)


def attach_bags(cohort: DataFrame, spec: CohortSpec, inventory: DataFrame, validate: bool = True) -> DataFrame:
    """Cohort joined to stored bags; a name that occurs twice in the inventory is an error."""
    if validate:
        twice = inventory.groupBy("name").count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"duplicate bag name {twice[0]['name']}")
    return strict_merge(cohort, inventory.withColumnRenamed("name", spec.name_col), spec, validate=validate)


def not_done(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key is not in the output table yet (reuse of a previous run)."""
    return items.join(done.select(key), key, "left_anti")


def pop_names(df: DataFrame, names: DataFrame, spec: CohortSpec, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose name is listed, rows that share no id with them)."""
    popped = df.join(names.select(spec.name_col), spec.name_col, "left_semi")
    return popped, keep_keys(df, popped.select(id_col).distinct(), [id_col], anti=True)


def split_overlap(df: DataFrame, spec: CohortSpec, id_col: str | None = None) -> DataFrame:
    """(split1, split2, id) for every id that occurs in both splits of a pair.

    An id has at most as many rows here as there are splits, so no pairs are formed inside large groups.
    """
    id_col = id_col or spec.name_col
    per_id = df.select(spec.split_col, id_col).distinct().groupBy(id_col).agg(
        F.array_sort(F.collect_list(spec.split_col)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(
        F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split1"), b.alias("split2")))))
    return per_id.select(F.col(id_col), F.explode(pairs).alias("p")).select("p.split1", "p.split2", id_col)


def upsert(df: DataFrame, patch: DataFrame, key: str, new_columns: bool = True) -> DataFrame:
    """Non-null values of ``patch`` replace those of rows with the same key; keys only in ``patch`` are ignored; its
    extra columns are appended. Column types of ``df`` are kept. ``patch`` has one row per key."""
    p = patch.select(*[F.col(c).alias(key if c == key else f"__p_{c}") for c in patch.columns])
    j = df.join(p, key, "left")
    types = dict(df.dtypes)
    cols = [F.coalesce(F.col(f"__p_{c}").cast(types[c]), F.col(c)).alias(c) if c != key and c in patch.columns
            else F.col(c) for c in df.columns]
    extra = [F.col(f"__p_{c}").alias(c) for c in patch.columns if c not in df.columns] if new_columns else []
    return j.select(*cols, *extra)
