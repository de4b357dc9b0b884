"""Survival operators against NumPy brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagframe.functions import labels as L
from bagframe.operators import cox as CX
from bagframe.operators import survival as SV


def table(spark, t, e, s, g=None):
    return spark.createDataFrame([(i, float(a), int(b), float(c), (g[i] if g is not None else "g"))
                                  for i, (a, b, c) in enumerate(zip(t, e, s))], "id long, t double, e int, s double, g string")


def data(n=80, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 15, n).astype(float), rng.integers(0, 2, n), rng.integers(0, 12, n) / 4


def brute_concordance(t, e, s):
    comp = conc = tied = 0
    for i in range(len(t)):
        for j in range(len(t)):
            if e[i] == 1 and (t[i] < t[j] or (t[i] == t[j] and e[j] == 0)):
                comp += 1
                conc += s[i] < s[j]
                tied += s[i] == s[j]
    return comp, conc, tied


@pytest.mark.parametrize("blocks", [1, 3])
def test_concordance(spark, blocks):
    for seed in range(2):
        t, e, s = data(seed=seed)
        r = SV.concordance(table(spark, t, e, s), "t", "e", "s", blocks=blocks).first()
        assert (r["comparable"], r["concordant"], r["tied"]) == brute_concordance(t, e, s)


def test_concordance_without_comparable_pairs(spark):
    r = SV.concordance(table(spark, [1, 2, 3], [0, 0, 0], [1, 2, 3]), "t", "e", "s").first()
    assert r["cind"] is None and r["comparable"] == 0


def test_kaplan_meier_by_hand(spark):
    # a censored row at an event time stays at risk for that event; the last event takes survival to 0
    t, e = [1, 2, 2, 3, 4], [1, 1, 0, 0, 1]
    rows = SV.survival_curves(table(spark, t, e, t), "t", "e", ["g"]).orderBy("time").collect()
    assert [(r.time, r.at_risk, r.events, r.censored) for r in rows] == [(0, 5, 0, 0), (1, 5, 1, 0), (2, 4, 1, 1), (3, 2, 0, 1), (4, 1, 1, 0)]
    assert np.allclose([r.survival for r in rows], [1, 0.8, 0.6, 0.6, 0])
    assert np.allclose([r.cumulative_hazard for r in rows], [0, 0.2, 0.45, 0.45, 1.45])


def test_logrank_two_groups_of_four(spark):
    t, e, g = [1, 3, 4, 6, 2, 5, 7, 8], [1, 1, 0, 1, 1, 0, 1, 1], list("aaaabbbb")
    r = SV.logrank(table(spark, t, e, t, g), "t", "e", "g").first()
    t, e, a = np.array(t), np.array(e), np.array(g) == "a"
    u = v = 0.0
    for x in np.unique(t[e == 1]):
        n, n1, d = (t >= x).sum(), ((t >= x) & a).sum(), ((t == x) & (e == 1)).sum()
        u += ((t == x) & (e == 1) & a).sum() - d * n1 / n
        v += d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) if n > 1 else 0
    assert math.isclose(r["statistic"], u * u / v, rel_tol=1e-12)
    assert math.isclose(r["p"], math.erfc(math.sqrt(u * u / v / 2)), rel_tol=1e-9)


def efron(t, e, x, beta):
    eta, ll = x @ beta, 0.0
    for u in np.unique(t[e == 1]):
        d = (t == u) & (e == 1)
        risk, dead = np.exp(eta[t >= u]).sum(), np.exp(eta[d]).sum()
        ll += eta[d].sum() - sum(np.log(risk - k / d.sum() * dead) for k in range(d.sum()))
    return ll


def test_cox_fit_is_the_maximum(spark):
    t, e, s = data(120, 3)
    z = np.random.default_rng(4).standard_normal(120)
    df = table(spark, t, e, s).join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(z)], "id long, z double"), "id")
    m = CX.fit_cox(df, "t", "e", ["s", "z"])
    x = np.column_stack([s, z])
    best = efron(t, e, x, np.array(m.coef))
    assert math.isclose(best - efron(t, e, x, np.zeros(2)), m.log_likelihood - m.log_likelihood_null, rel_tol=1e-6)
    for step in ([1e-3, 0], [-1e-3, 0], [0, 1e-3], [0, -1e-3]):
        assert efron(t, e, x, np.array(m.coef) + step) < best


def test_expected_lifetime(spark):
    t, e, s = data(60, 5)
    df = table(spark, t, e, s)
    m = CX.fit_cox(df, "t", "e", ["s"])
    risk = np.exp((s - m.means[0]) * m.coef[0])
    times = np.unique(t)
    h = np.cumsum([((t == u) & (e == 1)).sum() / risk[t >= u].sum() for u in times])
    want = [np.trapezoid(np.exp(-h * r), times) for r in risk]
    got = {r.id: r.expected for r in CX.expected_lifetime(df, m, "t", "e", "id").collect()}
    assert np.allclose([got[i] for i in range(60)], want)


def test_cox_loss(spark):
    t, e, s = data(50, 7)
    got = SV.cox_loss(table(spark, t, e, s), "t", "e", "s").first()["loss"]
    want = -np.mean([s[i] - np.log(np.exp(s[t >= t[i]]).sum()) for i in range(50) if e[i]])
    assert math.isclose(got, want, rel_tol=1e-6)


def test_hazards_of_the_toy_array(spark):
    df = spark.createDataFrame([([0.0, 12.0, 120.0],), ([1.0, 4.0, 10.0],)], "x array<double>")
    got = [r[0] for r in df.select(L.hazards_to_survival(F.col("x"))).collect()]
    x = np.array([[0, 12, 120], [1, 4, 10]], float)
    assert np.allclose(got, np.exp(np.cumsum(np.log(1 - 1 / (1 + np.exp(-x)) + 1e-7), axis=1)))


def test_dichotomise_when_the_median_is_the_minimum(spark):
    rows = SV.dichotomise(table(spark, [1] * 5, [1] * 5, [2, 2, 2, 3, 4]), "s").orderBy("id").collect()
    assert [r.arm for r in rows] == [0, 0, 0, 1, 1]


def test_cox_says_when_it_does_not_converge(spark):
    """Durations ordered by the covariate: the likelihood grows without end."""
    df = spark.createDataFrame([(float(i), 1, float(-i)) for i in range(1, 30)], "t double, e int, x double")
    assert not CX.fit_cox(df, "t", "e", ["x"]).converged
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    t = rng.exponential(np.exp(-0.7 * x))
    df = spark.createDataFrame([(float(a), 1, float(b)) for a, b in zip(t, x)], "t double, e int, x double")
    model = CX.fit_cox(df, "t", "e", ["x"])
    assert model.converged and abs(model.coef[0] - 0.7) < 0.3


def test_expected_lifetime_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    n = 300
    x = rng.normal(size=n) * 3
    t, e = rng.exponential(np.exp(-0.5 * x)) + 0.01, rng.integers(0, 2, n)
    df = spark.createDataFrame([(i, float(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(t, e, x))], "id long, t double, e int, x double")
    model = CX.fit_cox(df, "t", "e", ["x"])
    got = {r["id"]: r["expected"] for r in CX.expected_lifetime(df, model, "t", "e", "id").collect()}
    h = np.exp((x - model.means[0]) * model.coef[0])
    times = np.unique(t)
    hazard = np.array([((t == u) & (e == 1)).sum() / h[t >= u].sum() for u in times])
    curve = np.exp(-np.outer(h, np.cumsum(hazard)))
    want = ((times[1:] - times[:-1]) * (curve[:, 1:] + curve[:, :-1]) / 2).sum(1)
    assert len(got) == n and np.allclose([got[i] for i in range(n)], want, rtol=1e-9)


def test_p_values_as_columns(spark):
    from bagframe.functions.stats import chi2_pvalue, chi2_sf

    stats = [0.0, 1e-6, 0.3, 1.0, 3.84, 7.9, 8.1, 20.0, 55.0, 300.0]
    df = spark.createDataFrame([(s, 1) for s in stats] + [(2.0, 0), (None, 1)], "s double, d int")
    got = [r["p"] for r in df.select(chi2_pvalue(F.col("s"), F.col("d")).alias("p")).collect()]
    assert np.allclose(got[:len(stats)], [chi2_sf(s, 1) for s in stats], rtol=1e-9, atol=1e-300) and got[-2:] == [1.0, None]


def test_survival_groups_are_sums_of_cells(spark):
    """Groups of one, two and three of four categories, rows without a category, and a category without an event."""
    import itertools

    from bagframe.operators import multiclass as M
    from bagframe.operators.spec import CohortSpec, TrainType

    rng = np.random.default_rng(12)
    rows = []
    for i in range(160):
        cat = [None, "a", "b", "c", "d"][int(rng.integers(0, 5))]
        rows.append((f"r{i}", "s0" if i % 3 else "s1", cat, float(rng.integers(1, 12)), 0 if cat == "d" else int(rng.integers(0, 2)), float(rng.integers(0, 9))))
    df = spark.createDataFrame(rows, "name string, split string, category string, time double, event int, risk double")
    spec = CohortSpec(TrainType.SURV, ("event", "time"))
    got = {(r.split, r.category_group): (r.n, r.comparable, r.concordant, r.tied) for r in M.evaluate_survival(df, spec, "risk", (1, 2, 3)).collect()}
    groups = {"_".join(g): set(g) for k in (1, 2, 3) for g in itertools.combinations("abcd", k)} | {"all": {None, "a", "b", "c", "d"}}
    want = {}
    for split in ("s0", "s1"):
        for name, members in groups.items():
            x = [r for r in rows if r[1] == split and r[2] in members]
            pairs = [(p, q) for p in x for q in x if p[4] == 1 and (p[3] < q[3] or p[3] == q[3] and q[4] == 0)]
            want[split, name] = (len(x), len(pairs), sum(p[5] < q[5] for p, q in pairs), sum(p[5] == q[5] for p, q in pairs))
    assert got == want


def test_category_groups_make_their_table_once(spark):
    from bagframe.operators import multiclass as M
    from bagframe.operators.spec import CohortSpec, TrainType

    df = spark.range(60).selectExpr("if(id % 3 = 0, 'test', 'train') as split", "concat('c', id % 2) as category", "cast(id % 7 as double) as duration",
                                    "cast(id % 2 as int) as event", "cast(id * 13 % 17 as double) as risk").distinct()
    out = M.evaluate_survival(df, CohortSpec(TrainType.SURV, ("event", "duration")), "risk", (1,))
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.split, r.category_group) for r in out.collect()} == {(s, g) for s in ("test", "train") for g in ("all", "c0", "c1")}
