"""Quantiles of array entries against NumPy, and what leaves the tasks."""

import math

import numpy as np
from pyspark.sql import functions as F

from bagframe.operators.narrowing import array_quantiles, entry_ranges, ordered_bits

QS = (0.0, 0.03, 0.5, 0.97, 1.0)


def test_bits_sort_like_doubles():
    x = np.array([-np.inf, -1e300, -2.5, -2.4999, -1e-320, -0.0, 0.0, 1e-320, 1.0, 1.0 + 2 ** -52, 7.0, np.inf, np.nan, -np.nan])
    bits = ordered_bits(x)
    assert bits[5] == bits[6] and bits[12] == bits[13]
    rest = np.delete(bits, [6, 13])
    assert (rest[1:] > rest[:-1]).all()


def _bags(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", rng.normal(size=32)) for _ in range(300)]
    rows += [("narrow", 1 + rng.random(32) / 1000) for _ in range(40)]
    rows += [("ties", np.round(rng.normal(size=8))) for _ in range(30)]
    rows += [("mixed", np.concatenate([rng.normal(size=5) * 10.0 ** rng.integers(-300, 300), [0.0, -0.0]])) for _ in range(50)]
    rows += [("one", np.array([4.0])), ("zeros", np.zeros(9)), (None, np.ones(3))]
    data = [(n, [float(v) for v in a]) for n, a in rows] + [("ties", [None, 2.0, None]), ("none", None), ("empty", []), ("nulls", [None])]
    return data, spark.createDataFrame(data, "name string, v array<double>").repartition(5)


def test_quantiles_against_numpy(spark):
    data, df = _bags(spark)
    for skip in (False, True):
        got = {r.name: r.quantiles for r in array_quantiles(df, "name", "v", QS, skip).select("name", "quantiles").collect()}
        want = {}
        for name in {n for n, _ in data if n is not None}:
            x = [v for n, a in data if n == name and a for v in a if v is not None and (v or not skip)]
            if x:
                want[name] = [float(np.quantile(np.array(x), q)) for q in QS]
        assert set(got) == set(want)
        for name, q in want.items():
            assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-300) for a, b in zip(got[name], q)), name


def test_only_counts_leave_the_first_pass(spark):
    data, df = _bags(spark)
    counts = entry_ranges(df, "name", "v")
    entries = sum(len([v for v in a if v is not None]) for n, a in data if a and n is not None)
    assert counts.agg(F.sum("n")).first()[0] == entries
    assert counts.where("name is null" if "name" in counts.columns else "key is null").count() == 0
    assert counts.where("key = 'narrow'").count() == 1 and counts.where("key = 'hot'").count() < 0.05 * 300 * 32


def test_empty_table(spark):
    assert array_quantiles(spark.createDataFrame([], "name string, v array<float>"), "name", "v", QS).count() == 0
