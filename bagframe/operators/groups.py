"""Category groups: which combinations of categories are evaluated, and which rows belong to them. Everything stays in tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagframe.operators.spec import CohortSpec

Sizes = Sequence[int] | None
Levels = Sequence[str | int]


def class_presence(df: DataFrame, spec: CohortSpec, level: str | int = "") -> DataFrame:
    """(category, classes): the sorted class numbers that occur in the category. One pass, one row per category."""
    found = [F.max(F.col(c) == 1).alias(f"__p{k}") for k, c in enumerate(spec.target_cols)]
    flags = df.where(F.col(spec.category(level)).isNotNull()).groupBy(F.col(spec.category(level)).alias("category")).agg(*found)
    return flags.select("category", F.array_compact(F.array(*[F.when(F.col(f"__p{k}"), F.lit(k)) for k in range(spec.n_classes)])).alias("classes"))


def _numbered(presence: DataFrame) -> DataFrame:
    """Adds i (1..n by name) and n. The window holds one row per category."""
    return presence.withColumn("i", F.row_number().over(Window.orderBy("category"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))


def _combinations(numbered: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(members): index arrays of the combinations of the given sizes, below n (a single category is a group of its own)."""
    out, grown = None, numbered.select("n", F.array("i").alias("members"))
    for size in range(1, max(sizes) + 1):
        if size > 1:
            last = F.element_at("members", -1)
            grown = grown.where(last < F.col("n")).select("n", "members", F.explode(F.sequence(last + 1, F.col("n"))).alias("j"))
            grown = grown.select("n", F.concat("members", F.array("j")).alias("members"))
        if size in sizes:
            kept = grown.where(F.greatest(F.col("n") - 1, F.lit(1)) >= size).select("members")
            out = kept if out is None else out.unionByName(kept)
    return out


def _subsets(numbered: DataFrame) -> DataFrame:
    """(members): index arrays of all subsets but the empty and the full one; 2^n of them, so n is the caller's business."""
    low, high = F.least(F.col("n"), F.lit(16)), F.greatest(F.col("n") - 16, F.lit(0))
    power = lambda e: F.pow(F.lit(2.0), e).cast("long")
    x = numbered.where("i = 1").select("n", F.explode(F.sequence(F.lit(0).cast("long"), power(low) - 1)).alias("lo"), high.alias("high"))
    x = x.withColumn("hi", F.explode(F.sequence(F.lit(0).cast("long"), power(F.col("high")) - 1)))
    mask = F.col("hi") * 65536 + F.col("lo")
    x = x.withColumn("members", F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.pmod(F.floor(mask / F.pow(F.lit(2.0), i - 1)), F.lit(2)) == 1))
    size = F.size("members")
    return x.where((size >= 1) & (size <= F.greatest(F.col("n") - 1, F.lit(1)))).select("members")


def _group_members(df: DataFrame, spec: CohortSpec, level: str | int, sizes: Sizes) -> DataFrame:
    """(category_group, size, category, n): a row per category of every evaluable group."""
    numbered = _numbered(class_presence(df, spec, level))
    combos = _subsets(numbered) if sizes is None else _combinations(numbered, list(sizes))
    rows = combos.select("members", F.explode("members").alias("i")).join(numbered, "i")
    named = rows.groupBy("members").agg(F.array_sort(F.collect_list("category")).alias("categories"),
                                        F.size(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("seen"), F.max("n").alias("n"))
    if spec.train_type.is_class_type:
        named = named.where(F.col("seen") == spec.n_classes)
    return named.select(F.array_join("categories", "_").alias("category_group"), F.size("categories").alias("size"), F.explode("categories").alias("category"), "n")


def category_groups(df: DataFrame, spec: CohortSpec, level: str | int = "", sizes: Sizes = None) -> DataFrame:
    """(category_group, size, category): combinations of categories, a row per category of each; for classification only those in
    which every class occurs.

    ``sizes`` are the numbers of categories to combine; None means every size from one to all but one, which are 2^n groups
    for n categories, so give sizes where there are many.
    """
    return _group_members(df, spec, level, sizes).drop("n")


def memberships(df: DataFrame, spec: CohortSpec, sizes: Mapping[str, Sizes] | Sizes = (1,), levels: Levels = ("", 2, 3)) -> dict[str, DataFrame]:
    """(level, category_group, category) for every category level of the table; a level with one category has no rows.
    ``sizes`` holds for all levels, or is given by level ("" for the first)."""
    out = {}
    for n in levels:
        if spec.category(n) in df.columns:
            chosen = sizes.get(str(n), (1,)) if isinstance(sizes, Mapping) else sizes
            found = _group_members(df, spec, n, chosen).where("n > 1")
            out[str(n)] = found.select(F.lit(f"category{n}").alias("level"), "category_group", "category")
    return out


def in_groups(rows: DataFrame, spec: CohortSpec, members: Mapping[str, DataFrame]) -> DataFrame:
    """The rows once for the whole table (level and category_group 'all') and once for each group they belong to."""
    cats = [spec.category(n) for n in members]
    plain = rows.drop(*cats)
    out = plain.select(F.lit("all").alias("level"), F.lit("all").alias("category_group"), *plain.columns)
    for n, table in members.items():
        own = rows.join(table, rows[spec.category(n)] == table["category"])
        out = out.unionByName(own.select("level", "category_group", *[rows[c] for c in plain.columns]))
    return out
