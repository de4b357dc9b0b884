"""Exact quantiles of the entries of array columns by narrowing.

A double's bits, with the sign's order mended, sort like the double. The first pass counts entries per key and value range, the upper
16 of the 64 bits, inside the tasks; the counts say which ranges hold the wanted places. The second pass lets only entries of
those ranges leave their tasks, equal ones as one row. So what is shuffled are keys x ranges and the different values of a few
ranges, 2^19 at the most where the entries are floats, and never the entries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagframe.operators.hot import COUNT, attach
from bagframe.session import cut_lineage

_SIGN = np.uint64(1 << 63)
_RANGE_BITS = np.uint64(48)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros are one value, all NaN are one and come last."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = np.ascontiguousarray(x, np.float64).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _entries(batch: pa.RecordBatch, column: str, skip_zero: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row of each entry, entry) of the arrays in a column, without nulls, and without zeros if asked for."""
    lists = batch.column(column)
    flat = lists.flatten()
    row = pa.compute.list_parent_indices(lists).to_numpy()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    keep = flat.is_valid().to_numpy(zero_copy_only=False)
    if skip_zero:
        keep &= x != 0
    return row[keep], x[keep]


def _counted(batch: pa.RecordBatch, row: np.ndarray, value: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(key, value, number) of the different values of every key of a batch."""
    code = batch.column("key").dictionary_encode()
    number = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)[row]
    row_of = number >= 0                                  # a null key belongs to no group
    number, value = number[row_of], value[row_of]
    order = np.lexsort((value, number))
    number, value = number[order], value[order]
    first = np.ones(len(number), bool)
    first[1:] = (number[1:] != number[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(first)
    return code.dictionary.take(pa.array(number[at])), value[at], np.diff(np.append(at, len(number)))


def entry_ranges(df: DataFrame, key: str, values: str, skip_zero: bool = False) -> DataFrame:
    """(key, range, n): entries per key and value range, ranges in the order of the values."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, x = _entries(batch, "v", skip_zero)
            keys, ranges, n = _counted(batch, row, (ordered_bits(x) >> _RANGE_BITS).astype(np.int32))
            yield pa.RecordBatch.from_pydict({"key": keys, "range": pa.array(ranges, pa.int32()), "n": pa.array(n, pa.int64())})

    rows = df.select(F.col(key).alias("key"), F.col(values).cast("array<double>").alias("v"))
    found = rows.mapInArrow(scan, f"key {rows.schema['key'].dataType.simpleString()}, range int, n long")
    return found.groupBy("key", "range").agg(F.sum("n").alias("n"))


def array_quantiles(df: DataFrame, key: str, values: str, qs: Sequence[float], skip_zero: bool = False) -> DataFrame:
    """(key, quantiles, COUNT): exact, linearly interpolated quantiles of all entries of a key's arrays, and the number of the key's rows. Null entries
    do not count, nor zeros with ``skip_zero``; a key without entries has no row, nor has a null key. NaN sorts last."""
    counts = cut_lineage(entry_ranges(df, key, values, skip_zero))
    order = Window.partitionBy("key").orderBy("range")                       # at most 65536 rows
    total = F.sum("n").over(Window.partitionBy("key"))
    ranges = counts.withColumn("total", total).withColumn("before", F.sum("n").over(order) - F.col("n"))
    places = [(f"{side}{i}", fn(F.lit(float(q)) * (F.col("total") - 1)).cast("long")) for i, q in enumerate(qs) for side, fn in (("lo", F.floor), ("hi", F.ceil))]
    holds = [((F.col("before") <= at) & (at < F.col("before") + F.col("n"))) for _, at in places]
    wanted = ranges.where(F.exists(F.array(*holds), lambda h: h))
    rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias(COUNT))
    goals = cut_lineage(wanted.groupBy("key").agg(F.collect_list("range").alias("wanted"), F.collect_list("before").alias("befores"),
                                                  F.max("total").alias("total")).join(rows, "key"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, x = _entries(batch, "v", skip_zero)
            bits = ordered_bits(x)
            # (row, range) as one number, looked up among the wanted ones
            lists = batch.column("wanted")
            parent = pa.compute.list_parent_indices(lists).to_numpy()
            goal = np.sort(parent.astype(np.int64) << 16 | lists.flatten().to_numpy())
            mine = row.astype(np.int64) << 16 | (bits >> _RANGE_BITS).astype(np.int64)
            at = np.minimum(np.searchsorted(goal, mine), max(len(goal) - 1, 0))
            keep = goal[at] == mine if len(goal) else np.zeros(len(mine), bool)
            keys, found, n = _counted(batch, row[keep], bits[keep])
            back = np.where(found & _SIGN, found & ~_SIGN, ~found).view(np.float64)
            yield pa.RecordBatch.from_pydict({"key": keys, "range": pa.array((found >> _RANGE_BITS).astype(np.int32)), "value": pa.array(back), "n": pa.array(n, pa.int64())})

    asked = attach(df.select(F.col(key).alias("key"), F.col(values).cast("array<double>").alias("v")), goals.select("key", "wanted", COUNT), ["key"])
    kind = asked.schema["key"].dataType.simpleString()
    found = asked.mapInArrow(scan, f"key {kind}, range int, value double, n long").groupBy("key", "range", "value").agg(F.sum("n").alias("n"))
    base = goals.select("key", "total", F.explode(F.arrays_zip("wanted", "befores")).alias("z")).select("key", "total", F.col("z.wanted").alias("range"), F.col("z.befores").alias("below"))
    inside = Window.partitionBy("key", "range").orderBy("value")
    found = found.withColumn("upto", F.sum("n").over(inside)).join(base, ["key", "range"])
    first, last = F.col("below") + F.col("upto") - F.col("n"), F.col("below") + F.col("upto") - 1
    picks = [F.max(F.when((first <= at) & (at <= last), F.col("value"))).alias(name) for name, at in places]
    picked = found.groupBy("key").agg(*picks, F.max("total").alias("total"))
    share = [F.lit(float(q)) * (F.col("total") - 1) for q in qs]
    cells = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (at - F.floor(at)) for i, at in enumerate(share)]
    return picked.select("key", F.array(*cells).alias("quantiles")).join(goals.select("key", COUNT), "key").withColumnRenamed("key", key)
