"""Per-key statistics joined back to rows when one key may hold a third of all rows.

Spark's adaptive skew join splits a key only if both sides are plain shuffles; statistics are an aggregate over the same keys,
so it does not. Here the SHARE keys with the most rows are found by the aggregate's own counts: every key with more than 1 / SHARE of the rows
is among them. Their statistics, at most SHARE rows, are broadcast, and their rows are dealt to the tasks by content instead of by key.
The aggregate is computed once: the largest keys and the join read the same shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many of the largest keys are taken as hot.
SHARE = 64
COUNT = "__rows"
_DEEP = ("array", "map", "struct", "binary", "variant")


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """rows with the columns of ``stats``, which has one row per key and the number of the key's rows in the column COUNT.
    ``how``: inner or left. A NULL key matches nothing, as in any equi-join."""
    keys = list(keys)
    values = [c for c in stats.columns if c not in keys and c != COUNT]
    packed = F.struct(*[F.col(c) for c in values], F.lit(True).alias("__there"))
    hot = stats.orderBy(F.col(COUNT).desc()).limit(SHARE).select(*keys, packed.alias("__hot"))
    # 0, but no literal: a literal key would be folded into a condition, and the join would deal by the other keys alone
    zero = F.pmod(F.col(COUNT), F.lit(1)).cast("long")
    cold = stats.select(*keys, zero.alias("__deal"), packed.alias("__cold"))
    spread = [F.col(c) for c, t in rows.dtypes if c not in keys and not t.startswith(_DEEP)]
    x = rows.join(F.broadcast(hot), keys, "left")
    # rows of hot keys are done; they travel on to any task, the same one again if the task is repeated
    deal = F.pmod(F.xxhash64(*spread, F.spark_partition_id()), F.lit(1 << 20)) + 1
    x = x.withColumn("__deal", F.when(F.col("__hot").isNotNull(), deal).otherwise(F.lit(0).cast("long")))
    x = x.join(cold, [*keys, "__deal"], "left")
    if how == "inner":
        x = x.where(F.col("__hot").isNotNull() | F.col("__cold").isNotNull())
    return x.select(*rows.columns, *[F.coalesce(F.col("__hot")[c], F.col("__cold")[c]).alias(c) for c in values])


def with_stats(rows: DataFrame, keys: Sequence[str], how: str = "inner", **aggs: Column) -> DataFrame:
    """rows with aggregates over their key."""
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(COUNT), *[e.alias(c) for c, e in aggs.items()])
    return attach(rows, stats, keys, how)


def attach_table(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """rows with the columns of a table that has one row per key; the keys' counts are taken from the rows."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(COUNT))
    return attach(rows, counts.join(table, list(keys)), keys, how)


def keep_keys(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], anti: bool = False) -> DataFrame:
    """Semi or anti join with a table of distinct keys."""
    x = attach_table(rows, wanted.select(*keys, F.lit(True).alias("__wanted")), keys, "left")
    return x.where(F.col("__wanted").isNull() if anti else F.col("__wanted")).select(*rows.columns)
