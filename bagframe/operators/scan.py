"""Ordered scans (prefix sums) without ever sorting a whole group in one task.

ROC curves, AUC, Kaplan-Meier, Cox sums, concordance, exact quantiles, fold numbers and weighted sampling all
need a running total along an ordered key. ``Window.partitionBy(group)`` would put a whole group, possibly a
third of the table, into one task. Here the table is cut into key ranges first:

1. the caller pre-aggregates to one row per (group, key), so a hot key is a single row;
2. range bounds come from ``percentile_approx`` (a mergeable sketch) or from an explicit block column;
3. running totals are computed inside (group, range), which is at most one range of the whole table;
4. range totals (at most ``blocks`` rows per group) are turned into offsets and joined back.

Rows with a NULL group value belong to no group and are left out, as in a group-by selection on equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagframe.session import default_blocks

BLOCK = "__block"


def with_blocks(df: DataFrame, key: str, blocks: int | None = None, shared: Sequence[str] = ()) -> DataFrame:
    """Add the number of the key range a row falls into, ascending.

    Ranges are quantiles of the keys of the whole table, all groups together. A range holds about 1 / blocks of all
    rows, so no (group, range) can hold more, however large its group is; and the bounds are one small array that
    needs no join. The sketch pass mentions the ``shared`` columns (in a condition that always holds), so that
    column pruning leaves it the same pre-aggregation shuffle as the main pass, and Spark runs that shuffle once.
    """
    n = blocks or default_blocks(df.sparkSession)
    if n <= 1:
        return df.withColumn(BLOCK, F.lit(0))
    value = F.when(F.hash(*shared) % 2 < 2, F.col(key)) if shared else F.col(key)
    cuts = F.percentile_approx(value, [i / n for i in range(1, n)], F.lit(max(1000, 10 * n)))
    x = df.withColumn("__cuts", df.agg(cuts).scalar())
    return _count_below(x, "__cuts", key, n - 1).drop("__cuts")


def _count_below(df: DataFrame, cuts: str, key: str, size: int) -> DataFrame:
    """Add the number of array elements below the key by binary search. Each step is its own column, so the search
    stays inside generated code; a lambda over the array would be interpreted for every element."""
    out = df.withColumn(BLOCK, F.lit(0))
    step = 1 << (size.bit_length() - 1)
    while step:
        below = F.get(F.col(cuts), F.col(BLOCK) + (step - 1)) < F.col(key)
        out = out.withColumn(BLOCK, F.col(BLOCK) + F.when(below, step).otherwise(0))
        step //= 2
    return out


def ordered_scan(
    df: DataFrame,
    key: str,
    group: Sequence[str] = (),
    sums: Sequence[str] = (),
    next_cols: Sequence[str] = (),
    descending: bool = False,
    blocks: int | None = None,
    block_expr: Column | None = None,
    keep_block: bool = False,
) -> DataFrame:
    """Running totals along ``key`` for a table with one row per (group, key).

    Adds ``cum_<s>`` (this row included) and ``total_<s>`` (whole group) for each column in ``sums``, and
    ``next_<c>`` (value on the following row, NULL on the last) for each column in ``next_cols``.
    ``block_expr`` replaces the ranges by a monotone function of the key, which saves the sketch pass. ``keep_block`` leaves the range number in the result,
    so that a second scan of the same rows can use it and needs no new shuffle of the rows.
    """
    group = list(group)
    if block_expr is not None:
        x = df.withColumn(BLOCK, block_expr)
    else:
        x = with_blocks(df, key, blocks, [*group, *sums, *next_cols])

    def ordering(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    parts = [*group, BLOCK]
    inside = Window.partitionBy(*parts).orderBy(ordering(key))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.max_by if descending else F.min_by

    totals = [F.sum(s).alias(f"__t_{s}") for s in sums]
    if next_cols:
        totals.append(edge(F.struct(*next_cols), F.col(key)).alias("__first"))
    per_block = x.groupBy(*parts).agg(*totals)
    across = Window.partitionBy(*group).orderBy(ordering(BLOCK))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = per_block.select(
        *parts,
        *[F.sum(f"__t_{s}").over(before).alias(f"__o_{s}") for s in sums],
        *[F.sum(f"__t_{s}").over(whole).alias(f"total_{s}") for s in sums],
        *([F.lead("__first").over(across).alias("__after")] if next_cols else []),
    )

    x = x.select(
        "*",
        *[F.sum(s).over(upto).alias(f"__i_{s}") for s in sums],
        *([F.lead(F.struct(*next_cols)).over(inside).alias("__follow")] if next_cols else []),
    )
    x = x.join(offsets, parts)
    zero = F.lit(0)
    return x.select(
        *df.columns, *([BLOCK] if keep_block else []),
        *[(F.col(f"__i_{s}") + F.coalesce(F.col(f"__o_{s}"), zero)).alias(f"cum_{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums],
        *[F.coalesce(F.col("__follow"), F.col("__after"))[c].alias(f"next_{c}") for c in next_cols],
    )


def hash60(*parts: Column | str) -> Column:
    """A 60-bit number from md5 of the parts joined by ``:``. Stable across runs, engines and retries."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.col(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_position(df: DataFrame, group: Sequence[str], ids: Sequence[str], salt: Sequence[Column | str] = (),
                  out: str = "pos", blocks: int | None = None) -> DataFrame:
    """0-based position of every row when a group is put in md5 order of (salt, ids); ``total`` is the group size.

    The hash is uniform, so ranges are cut by arithmetic. Equal hashes (about one per billion ids) are ordered
    by the ids themselves.
    """
    group = list(group)
    n = blocks or default_blocks(df.sparkSession)
    x = df.withColumn("__h", hash60(*salt, *[F.col(i).cast("string") for i in ids]))
    x = x.withColumn(BLOCK, (F.col("__h") / F.lit(float(1 << 60) / n)).cast("int"))
    parts = [*group, BLOCK]
    sizes = x.groupBy(*parts).agg(F.count(F.lit(1)).alias("__n"))
    across = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*parts, F.coalesce(F.sum("__n").over(across), F.lit(0)).alias("__o"),
                           F.sum("__n").over(Window.partitionBy(*group)).alias("total"))
    inside = Window.partitionBy(*parts).orderBy("__h", *ids)
    x = x.withColumn("__r", F.row_number().over(inside)).join(offsets, parts)
    return x.select(*df.columns, (F.col("__r") - 1 + F.col("__o")).cast("long").alias(out), "total")


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], group: Sequence[str] = (),
                    blocks: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group: one row (group..., ``quantiles`` ARRAY<DOUBLE>)."""
    group = list(group)
    counts = (df.where(F.col(value).isNotNull()).withColumn("__v", F.col(value).cast("double"))
              .groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("n")))
    s = ordered_scan(counts, "__v", group, ["n"], blocks=blocks)
    picks = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("total_n") - 1)
        first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
        for name, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((first <= pos) & (pos <= last), F.col("__v"))).alias(f"__{name}{i}"))
        picks.append(F.max(at - F.floor(at)).alias(f"__f{i}"))
    a = s.groupBy(*group).agg(*picks)
    cols = [F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}") for i in range(len(qs))]
    return a.select(*group, F.array(*cols).alias("quantiles"))
