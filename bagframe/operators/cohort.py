"""Cohort tables: selection, label changes, columns, unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from bagframe.functions import labels as L
from bagframe.operators.spec import CohortSpec, TrainType


def _list(v) -> list:
    return list(v) if isinstance(v, (list, tuple, set)) else [v]


def with_labels(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """Add ``label`` (class index, or index array for multilabel) and ``classes`` (class names as text)."""
    if not spec.train_type.is_class_type:
        raise ValueError("labels exist only for classification cohorts")
    label = L.argmax(spec.target_cols) if spec.train_type is TrainType.CLF else L.label_indices(spec.target_cols)
    return df.withColumns({spec.label_col: label, spec.classes_col: L.class_text(spec.target_cols)})


def select_rows(df: DataFrame, spec: CohortSpec, split=None, category=None, names=None, level: str | int = "") -> DataFrame:
    """Rows of the given split(s), category(ies) of a level, and names."""
    if split is not None:
        df = df.where(F.col(spec.split_col).isin(_list(split)))
    if category is not None:
        df = df.where(F.col(spec.category(level)).isin(_list(category)))
    if names is not None:
        if isinstance(names, DataFrame):
            df = df.join(names.select(F.col(names.columns[0]).alias(spec.name_col)), spec.name_col, "left_semi")
        else:
            df = df.where(F.col(spec.name_col).isin(_list(names)))
    return df


def select_split(df: DataFrame, spec: CohortSpec, split=None) -> DataFrame:
    """None, 'all' and 'All' mean every split."""
    if split is None or (isinstance(split, str) and split in ("all", "All")):
        return df
    return select_rows(df, spec, split=split)


def names_in_categories(df: DataFrame, spec: CohortSpec, categories) -> DataFrame:
    return select_rows(df, spec, category=categories).select(spec.name_col)


def image_of(df: DataFrame, spec: CohortSpec, name: str) -> DataFrame:
    return df.where(F.col(spec.name_col) == name).select(spec.name_col, image_path(df).alias("image"))


def image_path(df: DataFrame, candidates: Sequence[str] = ("image", "wsi_path", "img")) -> Column:
    """First non-missing path column; several paths separated by commas keep the first, trimmed."""
    present = [F.col(c) for c in candidates if c in df.columns]
    return F.trim(F.element_at(F.split(F.coalesce(*present), ","), 1))


def delete_categories(df: DataFrame, spec: CohortSpec, categories) -> DataFrame:
    c = F.col(spec.category_col)
    return df.where(c.isNull() | ~c.isin(_list(categories)))


def rename_categories(df: DataFrame, spec: CohortSpec, mapping: Mapping[str, str]) -> DataFrame:
    """Renames are applied one after the other, so a later pair sees the result of an earlier one."""
    c = reduce(lambda e, kv: F.when(e == kv[0], F.lit(kv[1])).otherwise(e), mapping.items(), F.col(spec.category_col))
    return df.withColumn(spec.category_col, c)


def remap_labels(df: DataFrame, spec: CohortSpec, mapping: Mapping[str, str], order: Sequence[str] | None = None,
                 drop_old: bool = True) -> tuple[DataFrame, CohortSpec]:
    """Many-to-one over one-hot columns: a new class is set when any of its old classes is. Returns table and spec."""
    if not spec.train_type.is_class_type:
        raise ValueError("only for classification cohorts")
    full = {c: c for c in spec.target_cols} | dict(mapping)
    if all(k == v for k, v in full.items()):
        return df, spec
    order = list(order) if order is not None else list(dict.fromkeys(full.values()))
    new = {}
    for n in order:
        olds = [F.coalesce((F.col(o) == 1).cast("int"), F.lit(0)) for o, v in full.items() if v == n and o in df.columns]
        new[n] = (F.greatest(*olds) if len(olds) > 1 else olds[0] if olds else F.lit(0)).cast("int")
    rest = [c for c in df.columns if c not in new and c != spec.label_col and not (drop_old and c in spec.target_cols)]
    out = df.select(*rest, *[e.alias(n) for n, e in new.items()])
    return out, CohortSpec(spec.train_type, tuple(order), spec.name_col, spec.split_col, spec.category_col,
                           spec.label_col, spec.classes_col, spec.out_prefix, spec.pred_prefix, spec.categories_order)


def delete_secondary_label(df: DataFrame, spec: CohortSpec, label: str) -> DataFrame:
    """Unset ``label`` on rows that have any other label."""
    if spec.train_type is not TrainType.MULTILABEL:
        raise ValueError("only for multilabel cohorts")
    if label not in spec.target_cols:
        raise ValueError(f"unknown label {label}")
    others = reduce(lambda a, b: a + b, [F.col(c) for c in spec.target_cols if c != label])
    return df.withColumn(label, F.when((F.col(label) == 1) & (others >= 1), 0).otherwise(F.col(label)).cast("int"))


def merge_splits(df: DataFrame, spec: CohortSpec, splits: Sequence[str] = ("training", "validation"),
                 merged: str = "train_valid") -> DataFrame:
    s = F.col(spec.split_col)
    return df.withColumn(spec.split_col, F.when(s.isin(list(splits)), merged).otherwise(s))


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One convention for missing numbers: NULL."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")]
    cols = [c for c in (cols or floats) if c in floats]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols}) if cols else df


def _missing(df: DataFrame, c: str) -> Column:
    is_float = dict(df.dtypes)[c] in ("float", "double")
    return F.col(c).isNull() | F.isnan(c) if is_float else F.col(c).isNull()


def rows_with_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [_missing(df, c) for c in (cols or df.columns)]))


def drop_missing(df: DataFrame, cols: Sequence[str], observe: Observation | None = None) -> DataFrame:
    """Rows with a value in all ``cols``. ``observe`` receives kept and total counts from the same pass."""
    keep = ~reduce(lambda a, b: a | b, [_missing(df, c) for c in cols])
    if observe is not None:
        df = df.observe(observe, F.count(F.lit(1)).alias("total"), F.count_if(keep).alias("kept"))
    return df.where(keep)


def columns_starting_with(df: DataFrame, prefix: str, not_starting: str | None = None) -> list[str]:
    return sorted(c for c in df.columns if c.startswith(prefix) and not (not_starting and c.startswith(not_starting)))


def out_columns(df: DataFrame, spec: CohortSpec) -> list[str]:
    return columns_starting_with(df, spec.out_prefix)


def pred_columns(df: DataFrame, spec: CohortSpec) -> list[str]:
    return columns_starting_with(df, spec.pred_prefix, spec.pred_prefix + "_")


def columns_first(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    front = [c for c in cols if c in df.columns]
    return df.select(*front, *[c for c in df.columns if c not in front])


def columns_last(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in cols], *cols)


def column_after(df: DataFrame, col: str, after: str | int) -> DataFrame:
    rest = [c for c in df.columns if c != col]
    at = df.columns.index(after) + 1 if isinstance(after, str) else after
    if isinstance(after, str) and df.columns.index(col) < at:
        at -= 1
    return df.select(*rest[:at], col, *rest[at:])


def delete_columns(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    return df.drop(*([c.strip() for c in cols.split(",")] if isinstance(cols, str) else cols))


def strip_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def normalise_columns(df: DataFrame) -> DataFrame:
    """Lower case, without & and #, spaces to underscores; two columns that become equal are an error."""
    new = [c.replace("&", "").replace("#", "").lower().strip().replace(" ", "_") for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError(f"duplicate column names after normalising: {sorted(new)}")
    return df.toDF(*new)


def column_to_string(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col).cast("string"))


def look_up(df: DataFrame, col: str, lookup: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Two columns of ``lookup`` used as a dictionary for ``col``; the last (largest) value of a repeated key wins."""
    d = lookup.groupBy(F.col(key).alias(col)).agg(F.max(value).alias(out))
    return df.join(d, col, "left")


def single_label_rows(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Rows with fewer than two positive variables."""
    return df.where(reduce(lambda a, b: a + b, [F.col(v) for v in variables]) < 2)


def retry_set(report: DataFrame) -> DataFrame:
    """Items of a run report that neither succeeded nor were already done."""
    return report.where(~F.coalesce(F.col("ok"), F.lit(False)) & ~F.coalesce(F.col("existed"), F.lit(False)))


def concat(*dfs: DataFrame) -> DataFrame:
    """Union by name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def add_cohort(df: DataFrame, other: DataFrame, spec: CohortSpec, same_cols: bool = False) -> DataFrame:
    """Append a cohort. ``same_cols`` demands equal column sets, otherwise both need category, split, name, targets."""
    if same_cols:
        if set(df.columns) != set(other.columns):
            raise ValueError(f"different columns: {sorted(df.columns)} and {sorted(other.columns)}")
    else:
        need = {spec.category_col, spec.split_col, spec.name_col, *spec.target_cols}
        for d in (df, other):
            if not need <= set(d.columns):
                raise ValueError(f"missing columns {sorted(need - set(d.columns))}")
    return concat(df, other)


def _keys(right: DataFrame, key: str) -> DataFrame:
    """The keys of ``right`` as the hashed side of a semi or anti join. A task then holds each of its distinct keys once and lets the left rows
    pass, whereas a merge join sorts all rows of both lists, and a broadcast, chosen by file sizes, would hold a whole list."""
    return right.select(key).hint("shuffle_hash")


def intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows (duplicates kept) whose key is in right. No list is sorted: see :func:`_keys`."""
    return left.join(_keys(right, key), key, "left_semi")


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows (duplicates kept) whose key is not in right; a NULL key is never in right."""
    return left.join(_keys(right, key), key, "left_anti")


def distinct_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).subtract(right.select(key))


def surpluses(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(in both, only left, only right)."""
    return intersection(left, right, key), difference(left, right, key), difference(right, left, key)


def distinct_in_order(df: DataFrame, key: str, position: str) -> DataFrame:
    """First row of every key by position."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(position)).alias("__r")).select(
        *[F.col(key) if c == key else F.col("__r")[c].alias(c) for c in df.columns])


def invert_lists(df: DataFrame, key: str, values: str) -> DataFrame:
    """key -> [values] to value -> sorted [keys]."""
    x = df.select(F.col(key), F.explode(values).alias("value")).distinct()
    return x.groupBy("value").agg(F.array_sort(F.collect_list(key)).alias("keys"))


def invert_unique_lists(df: DataFrame, key: str, values: str) -> DataFrame:
    """key -> [values] to value -> key; a value of several keys is an error."""
    x = df.select(F.col(key), F.explode(values).alias("value"))
    several = F.raise_error(F.concat(F.col("value").cast("string"), F.lit(" occurs several times"))).cast("string")
    return x.groupBy("value").agg(F.min(key).alias("__k"), F.count(F.lit(1)).alias("__n")).select(
        "value", F.when(F.col("__n") > 1, several).otherwise(F.col("__k").cast("string")).alias("key"))


def infer_targets(df: DataFrame, col: str) -> tuple[TrainType, DataFrame, int]:
    """Find the train type of a target column (number, or array of numbers) and expand it.

    One number per row: integers are a classification (shifted to start at 0, gaps are an error), fractions a
    regression. Lists: integers are multilabel, fractions of equal length a regression with several outputs.
    Returns (type, table with columns t0.., number of columns). One aggregate decides; for multilabel the sorted distinct classes
    come to the driver, as each becomes a column: their number is bounded by what a table can hold as columns.
    """
    a = F.col(col) if dict(df.dtypes)[col].startswith("array") else F.array(F.col(col))
    x = df.withColumn("__a", F.transform(a, lambda v: v.cast("double")))
    ints = F.forall("__a", lambda v: v % 1 == 0)
    f = x.agg(F.min(F.size("__a")).alias("lo"), F.max(F.size("__a")).alias("hi"), F.bool_and(ints).alias("ints"),
              F.min(F.array_min("__a")).alias("mn"), F.max(F.array_max("__a")).alias("mx")).first()
    if f["lo"] == f["hi"] == 1:
        if not f["ints"]:
            return TrainType.REGR, x.withColumn("t0", F.col("__a")[0]).drop("__a"), 1
        n = int(f["mx"] - f["mn"]) + 1
        found = x.select(F.col("__a")[0]).agg(F.count_distinct(F.col("__a[0]"))).first()[0]
        if found != n:
            raise ValueError(f"{found} classes between {f['mn']} and {f['mx']}: bad ordering")
        cols = {f"t{k}": (F.col("__a")[0] - f["mn"] == k).cast("int") for k in range(n)}
        return TrainType.CLF, x.withColumns(cols).drop("__a"), n
    if f["ints"]:
        vals = [r[0] for r in x.select(F.explode("__a").alias("v")).distinct().orderBy("v").collect()]
        cols = {f"t{k}": F.array_contains("__a", F.lit(v)).cast("int") for k, v in enumerate(vals)}
        return TrainType.MULTILABEL, x.withColumns(cols).drop("__a"), len(vals)
    if f["lo"] != f["hi"]:
        raise ValueError("different numbers of non-integer targets")
    return TrainType.REGR, x.withColumns({f"t{k}": F.col("__a")[k] for k in range(f["lo"])}).drop("__a"), f["lo"]
