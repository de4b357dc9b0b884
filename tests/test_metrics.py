"""Metrics against NumPy brute force, hand-made cases, edge cases and plan checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagframe.functions.stats import chi2_sf
from bagframe.operators import binary as B
from bagframe.operators import multiclass as M
from bagframe.operators import scan as SC
from bagframe.operators.spec import CohortSpec, TrainType


def brute_auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n[None]).sum() + 0.5 * (p[:, None] == n[None]).sum()) / (len(p) * len(n))


def scored(spark, y, s, g=None):
    rows = [(i, int(a), float(b), (g[i] if g is not None else "g")) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "id long, y int, s double, g string")


@pytest.mark.parametrize("blocks", [1, 3, 7])
@pytest.mark.parametrize("descending", [False, True])
def test_scan_does_not_depend_on_blocks(spark, blocks, descending):
    rng = np.random.default_rng(0)
    keys = [(g, float(k)) for g in "abc" for k in np.unique(rng.integers(0, 200, 60))]
    vals = rng.integers(1, 9, len(keys))
    df = spark.createDataFrame([(g, k, int(v)) for (g, k), v in zip(keys, vals)], "g string, k double, v long")
    got = {(r.g, r.k): (r.cum_v, r.total_v, r.next_v) for r in
           SC.ordered_scan(df, "k", ["g"], ["v"], ["v"], descending, blocks).collect()}
    for g in "abc":
        part = sorted([(k, v) for (h, k), v in zip(keys, vals) if h == g], reverse=descending)
        run = 0
        for i, (k, v) in enumerate(part):
            run += v
            nxt = part[i + 1][1] if i + 1 < len(part) else None
            assert got[(g, k)] == (run, sum(x for _, x in part), nxt)


@pytest.mark.parametrize("blocks", [1, 5])
def test_auc_against_pairs(spark, blocks):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 40
    got = B.roc_auc(scored(spark, y, s), "y", "s", ["g"], blocks=blocks).first()["auc"]
    assert math.isclose(got, brute_auc(y, s), rel_tol=1e-12)
    flipped = B.roc_auc(scored(spark, 1 - y, 1 - s), "y", "s", ["g"]).first()["auc"]
    assert math.isclose(got, flipped, rel_tol=1e-12)


def test_auc_edges(spark):
    one = B.roc_auc(scored(spark, [1, 1, 1], [0.1, 0.2, 0.3]), "y", "s", ["g"]).first()
    assert one["auc"] is None and one["n"] == 3
    ties = B.roc_auc(scored(spark, [1, 0, 1, 0], [0.5] * 4), "y", "s", ["g"]).first()
    assert ties["auc"] == 0.5
    with pytest.raises(Exception, match="missing or NaN"):
        B.roc_auc(scored(spark, [1, 0], [0.5, float("nan")]), "y", "s").collect()


def test_threshold_must_exceed_the_high_negative(spark):
    rep = B.binary_report(scored(spark, [0, 1, 0, 1], [0.1, 0.2, 0.6, 0.7]), "y", "s", ["g"]).first()
    assert rep["threshold"] == 0.7
    assert (rep["tp"], rep["fp"], rep["fn"], rep["tn"]) == (1, 0, 1, 2)


def test_roc_drops_equally_spaced_points_and_sets_first_threshold(spark):
    y, s = [1, 1, 1, 0, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.5, 0.4]
    full = B.roc_curve(scored(spark, y, s), "y", "s", drop_intermediate=False).orderBy(F.desc("threshold")).collect()
    kept = B.roc_curve(scored(spark, y, s), "y", "s").orderBy(F.desc("threshold")).collect()
    assert len(full) == 7 and [r.threshold for r in kept] == [1.0, 0.9, 0.7, 0.4]
    high = B.roc_curve(scored(spark, y, np.array(s) * 10), "y", "s").agg(F.max("threshold")).first()[0]
    assert math.isinf(high)


def test_yates_chi_square_and_p(spark):
    # 2 x 2 table [[12, 5], [3, 9]]: corrected statistic by hand
    df = spark.createDataFrame([(12, 5, 3, 9)], "a long, b long, c long, d long")
    got = df.select(B.chi_square_2x2(*[F.col(c) for c in "abcd"]).alias("s")).first()["s"]
    n, obs = 29, np.array([[12, 5], [3, 9]])
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / n
    want = ((np.abs(obs - exp) - 0.5) ** 2 / exp).sum()
    assert math.isclose(got, want, rel_tol=1e-12)
    # table values of the chi-square distribution
    for stat, dof, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (11.344867, 3, 0.01), (18.307038, 10, 0.05)):
        assert math.isclose(chi2_sf(stat, dof), p, rel_tol=1e-5)


def _cells(spark, low_neg, high_neg, low_pos, high_pos):
    """A table of the given size by label and score, without a row object per row."""
    ends = np.cumsum([low_neg, high_neg, low_pos, high_pos])
    at = F.when(F.col("id") < int(ends[0]), 0).when(F.col("id") < int(ends[1]), 1).when(F.col("id") < int(ends[2]), 2).otherwise(3)
    return spark.range(int(ends[3])).select((at >= 2).cast("long").alias("y"), F.when(at % 2 == 1, 0.9).otherwise(0.1).alias("s"))


def test_p_value_of_a_large_table(spark):
    # the product of the four margins passes 64 bits
    obs = np.array([[100_000, 98_000], [99_000, 99_500]])
    got = B.chi_square_test(_cells(spark, *obs.ravel().tolist()), "y", "s", 0.5).first()
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    want = ((np.abs(obs - exp) - 0.5) ** 2 / exp).sum()
    assert math.isclose(got["statistic"], want, rel_tol=1e-12) and got["dof"] == 1
    assert math.isclose(got["p"], math.erfc(math.sqrt(want / 2)), rel_tol=1e-9)
    one_sided = B.chi_square_test(_cells(spark, 5, 0, 7, 0), "y", "s", 0.5).first()
    assert (one_sided["statistic"], one_sided["dof"], one_sided["p"]) == (0.0, 0, 1.0)


def test_report_of_a_large_table(spark):
    got = B.binary_report(_cells(spark, 100_000, 98_000, 99_000, 99_500), "y", "s", threshold=0.5).first()
    assert (got["tn"], got["fp"], got["fn"], got["tp"]) == (100_000, 98_000, 99_000, 99_500)
    assert 0 < got["p_thresh"] < 1 and math.isclose(got["p_thresh"], math.erfc(math.sqrt(got["chi2"] / 2)), rel_tol=1e-9)


def test_kappa_of_the_six_labels(spark):
    t, p = [0, 0, 1, 1, 2, 3], [3, 0, 2, 1, 3, 2]
    df = spark.createDataFrame(list(zip(t, p)), "t int, p int")
    m = M.matrix_metrics(M.confusion_matrix(df, "t", "p", 4)).first()
    cm = np.zeros((4, 4))
    for a, b in zip(t, p):
        cm[a, b] += 1
    row, col, n = cm.sum(1), cm.sum(0), cm.sum()
    w = (np.arange(4)[:, None] - np.arange(4)[None]) ** 2
    expected = np.outer(row, col) / n
    assert math.isclose(m["kappa_quadratic"], 1 - (w * cm).sum() / (w * expected).sum(), rel_tol=1e-12)
    po, pe = np.trace(cm) / n, (row * col).sum() / n**2
    assert math.isclose(m["kappa"], (po - pe) / (1 - pe), rel_tol=1e-12)
    assert m["fleiss"] == "Poor"


def test_multilabel_toy(spark):
    spec = CohortSpec(TrainType.MULTILABEL, ("a", "b", "c"))
    targ = [[1, 0, 0], [0, 1, 0], [1, 0, 1], [0, 1, 0], [0, 0, 1]]
    prob = [[0.8, 0.1, 0.1], [0.6, 0.8, 0.1], [0.3, 0.3, 0.7], [0.3, 0.2, 0.6], [0.3, 0.3, 0.65]]
    df = spark.createDataFrame([(str(i), "validation", *t, *p) for i, (t, p) in enumerate(zip(targ, prob))],
                               "name string, split string, a int, b int, c int, out0 double, out1 double, out2 double")
    th = {r["class"]: r["threshold"] for r in M.class_thresholds(df, spec).collect()}
    assert th == {"a": 0.8, "b": 0.8, "c": 0.65}
    pred = M.multilabel_predictions(df, spec, M.class_thresholds(df, spec))
    m = M.multilabel_metrics(pred, spec).first()
    assert m["n"] == 5 and math.isclose(m["acc"], 3 / 5)


def test_permutation_p_is_small_for_a_real_effect(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 120)
    strong = B.auc_permutation_test(scored(spark, y, y * 0.5 + rng.random(120)), "y", "s", "id", 100).first()
    weak = B.auc_permutation_test(scored(spark, y, rng.random(120)), "y", "s", "id", 100).first()
    assert strong["p"] < 0.02 and weak["p"] > 0.02


def test_regression_of_a_constant_target(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, o double")
    assert M.regression_metrics(df, ["y"], ["o"]).first()["r2"] == 1.0
    df = spark.createDataFrame([(1.0, 1.5), (1.0, 1.0)], "y double, o double")
    assert M.regression_metrics(df, ["y"], ["o"]).first()["r2"] == 0.0


@pytest.mark.parametrize("blocks", [1, 4])
def test_exact_quantiles(spark, blocks):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 50, 333) / 7
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = SC.exact_quantiles(df, "v", [0.0, 0.03, 0.5, 0.97, 1.0], blocks=blocks).first()["quantiles"]
    assert np.allclose(got, np.percentile(v, [0, 3, 50, 97, 100]))


def test_plans_have_no_cartesian_product(spark, sf):
    from bagframe.plans import QUERIES

    for name in ("binary_report_by_split", "binary_report_category_groups", "concordance_by_group", "cv_folds", "prefix_matches",
                 "contour_distances", "bags_scored", "cohort_summary"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_group_windows_are_cut_into_blocks(spark, sf):
    from bagframe.plans import fixtures as fx

    plan = B.roc_auc(fx.preds(spark, sf), "Pos", "out1", ["split"], blocks=8)._jdf.queryExecution().optimizedPlan().toString()
    sums = [line for line in plan.splitlines() if "Window [sum(pos" in line]
    assert sums and all("__block" in line for line in sums)
