"""Permutations by a keyed network: bijections for every size, null distributions, and plans without rows x permutations."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from bagframe.operators import binary as B
from bagframe.operators.permute import BLOCK_VALUES, SHELF, WIDTH, network, permuted_statistic, slots, with_partner


def _partners(n: int, k: int, seed: int = 1) -> list[int]:
    """The network step by step in Python's integers."""
    width = math.ceil(math.sqrt(n))
    out = []
    for slot in range(n):
        names = {"slot": slot, "n": n, "width": width, "k": k, "least": min}
        for name, expression in network("slot", "n", "width", "k", seed, "//"):
            names[name] = eval(expression, {}, names)  # noqa: S307  (the expressions are arithmetic)
        out.append(names["partner"])
    return out


def test_every_key_is_a_bijection_of_every_size():
    for n in [*range(1, 40), 64, 99, 100, 101, 257]:
        for k in (1, 2, 1999):
            assert sorted(_partners(n, k)) == list(range(n))
    assert _partners(50, 1) != _partners(50, 2) != _partners(50, 1, seed=2)


def test_spark_computes_the_same_partners(spark):
    df = spark.range(101).selectExpr("id as slot", "101L as n", f"{WIDTH.format(n='101')} as width", "7L as k")
    got = {r.slot: r.partner for r in with_partner(df, "n", "width", "k", 3).collect()}
    assert [got[i] for i in range(101)] == _partners(101, 7, 3)


def _rows(spark, n=230):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(f"r{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))], "name string, a double, b double")


def test_blocks_do_not_change_the_statistic(spark):
    rows = slots(_rows(spark), "name", blocks=4)
    one = {r.perm: r.s for r in permuted_statistic(rows, F.col("a"), F.col("b"), F.lit(True), F.corr("a", "b"), 60).collect()}
    many = {r.perm: r.s for r in permuted_statistic(rows, F.col("a"), F.col("b"), F.lit(True), F.corr("a", "b"), 60, block_values=17, deals=3).collect()}
    assert set(one) == set(range(1, 61)) and all(math.isclose(one[k], many[k], abs_tol=1e-12) for k in one)
    # a null distribution: mean 0 and variance 1 / (n - 1)
    values = np.array(list(one.values()))
    assert abs(values.mean()) < 4 / math.sqrt(60 * 229) and 0.5 < values.var() * 229 < 1.8
    local = {r.slot: (r.a, r.b) for r in rows.collect()}
    pairs = np.array([(local[s][0], local[t][1]) for s, t in enumerate(_partners(230, 9))])
    assert math.isclose(one[9], np.corrcoef(pairs.T)[0, 1], abs_tol=1e-12)


def test_selected_rows_meet_all_partners(spark):
    rows = slots(_rows(spark, 50), "name", blocks=2)
    got = {r.perm: r.s for r in permuted_statistic(rows, F.lit(1), F.col("b"), F.col("slot") < 10, F.sum("b"), 5, block_values=7).collect()}
    local = {r.slot: r.b for r in rows.collect()}
    for k in range(1, 6):
        assert math.isclose(got[k], sum(local[t] for t in _partners(50, k)[:10]), abs_tol=1e-9)


def test_no_order_and_no_shuffle_per_permutation(spark):
    plan = permuted_statistic(slots(_rows(spark), "name"), F.col("a"), F.col("b"), F.lit(True), F.corr("a", "b"), 2000)._jdf.queryExecution().sparkPlan().toString()
    above, *below = re.split(r"Generate explode\([^\n]*\[perm#", plan)
    assert below and "Window" not in above and "Sort" not in above and "Join" not in above and "partial_corr" in above


def test_permutations_of_a_small_table_use_all_partitions(spark, tmp_path):
    slots(_rows(spark), "name", blocks=4).coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))                   # one file, which a broadcast join would read in one task
    met = permuted_statistic(rows, F.col("a"), F.col("b"), F.lit(True), F.corr("a", "b"), 20)
    assert len(met.collect()) == 20
    plan = met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    steps = re.findall(r"SortMergeJoin|BroadcastHashJoin|AQEShuffleRead|REPARTITION_BY_NUM", plan)
    assert "BroadcastHashJoin" not in steps and steps[steps.index("SortMergeJoin") + 1] == "REPARTITION_BY_NUM"      # not coalesced


def test_p_values_at_both_ends(spark):
    rows = _rows(spark, 150).withColumn("c", F.col("a") + F.col("b") / 10)
    strong = B.permutation_test(rows, "a", "c", "name", F.corr, 200).first()
    weak = B.permutation_test(rows, "a", "b", "name", F.corr, 200).first()
    assert strong["p"] == 1 / 201 and weak["p"] > 0.01 and strong["n"] == 150


def test_rows_travel_once_per_shelf_of_blocks(spark):
    rows = slots(_rows(spark), "name", blocks=4)
    one = {r.perm: r.s for r in permuted_statistic(rows, F.col("a"), F.col("b"), F.lit(True), F.corr("a", "b"), 30).collect()}
    # 14 blocks on 5 shelves, the last of each not full, and all on one
    for shelf in (3, 16):
        many = {r.perm: r.s for r in permuted_statistic(rows, F.col("a"), F.col("b"), F.lit(True), F.corr("a", "b"), 30, block_values=17, deals=3, shelf=shelf).collect()}
        assert many.keys() == one.keys() and all(math.isclose(one[k], many[k], abs_tol=1e-12) for k in one)
    # four million rows have one shelf by default: no row tries its permutations twice
    assert BLOCK_VALUES * SHELF >= 1 << 22
