"""Cox proportional hazards with Efron ties: Newton steps, each one Spark job over risk-set sums.

Only p + p(p+1)/2 + 1 numbers per step come to the driver (p covariates).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagframe.functions.stats import chi2_sf
from bagframe.operators.scan import BLOCK, ordered_scan
from bagframe.operators.survival import concordance

TIE_CHUNK = 4096
DIVERGING = 15.0


@dataclass(frozen=True)
class CoxModel:
    covariates: tuple[str, ...]
    coef: tuple[float, ...]
    std_err: tuple[float, ...]
    means: tuple[float, ...]
    log_likelihood: float
    log_likelihood_null: float
    n: int
    n_events: int
    iterations: int
    converged: bool
    """False if the step limit was reached, or a coefficient runs away because the likelihood has no finite maximum."""

    @property
    def lr_statistic(self) -> float:
        return 2 * (self.log_likelihood - self.log_likelihood_null)

    @property
    def p_value(self) -> float:
        """Likelihood ratio test against the model without covariates."""
        return chi2_sf(self.lr_statistic, len(self.coef))

    def log_hazard(self) -> Column:
        """Centred linear predictor."""
        return sum(((F.col(c).cast("double") - m) * b for c, m, b in zip(self.covariates, self.means, self.coef)),
                   F.lit(0.0))


def _risk_sums(rows: DataFrame, beta: np.ndarray, p: int) -> DataFrame:
    """Per distinct time: risk-set sums of e, x*e, x*x*e (running, from the latest time down) and the same over the
    events at that time."""
    eta = sum((F.col(f"x{k}") * float(beta[k]) for k in range(p)), F.lit(0.0))
    r = rows.withColumn("__e", F.exp(eta)).withColumn("__eta", eta)
    dead = F.col("event") == 1
    values = {"r": F.col("__e")}
    for k in range(p):
        values[f"r{k}"] = F.col(f"x{k}") * F.col("__e")
        for m in range(k, p):
            values[f"r{k}_{m}"] = F.col(f"x{k}") * F.col(f"x{m}") * F.col("__e")
    aggs = [F.sum(v).alias(n) for n, v in values.items()]
    aggs += [F.sum(F.when(dead, v).otherwise(0.0)).alias("d" + n[1:] if n != "r" else "dr") for n, v in values.items()]
    aggs += [F.count_if(dead).alias("deaths"), F.sum(F.when(dead, F.col("__eta")).otherwise(0.0)).alias("eta")]
    aggs += [F.sum(F.when(dead, F.col(f"x{k}")).otherwise(0.0)).alias(f"s{k}") for k in range(p)]
    per_time = r.groupBy("time").agg(*aggs)
    return ordered_scan(per_time, "time", [], list(values), descending=True)


def _newton_terms(rows: DataFrame, beta: np.ndarray, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    s = _risk_sums(rows, beta, p).where(F.col("deaths") > 0)
    pairs = [(k, m) for k in range(p) for m in range(k, p)]
    fixed = s.agg(F.sum("eta").alias("eta"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(p)])
    # a time with d tied events contributes d terms; large ties are cut into chunks spread over tasks
    chunks = s.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("deaths") - 1) / TIE_CHUNK))))
    chunks = chunks.repartition("time", "__c")
    lo = F.col("__c") * TIE_CHUNK
    hi = F.least(lo + TIE_CHUNK - 1, F.col("deaths") - 1)
    t = chunks.withColumn("__l", F.explode(F.sequence(lo, hi)))
    c = F.col("__l") / F.col("deaths")
    phi = F.col("cum_r") - c * F.col("dr")
    mean = [(F.col(f"cum_r{k}") - c * F.col(f"d{k}")) / phi for k in range(p)]
    aggs = [F.sum(F.log(phi)).alias("log_phi")] + [F.sum(mean[k]).alias(f"m{k}") for k in range(p)]
    aggs += [F.sum((F.col(f"cum_r{k}_{m}") - c * F.col(f"d{k}_{m}")) / phi - mean[k] * mean[m]).alias(f"h{k}_{m}")
             for k, m in pairs]
    a, f = t.agg(*aggs).first(), fixed.first()
    grad = np.array([f[f"s{k}"] - a[f"m{k}"] for k in range(p)])
    hess = np.zeros((p, p))
    for k, m in pairs:
        hess[k, m] = hess[m, k] = a[f"h{k}_{m}"]
    return f["eta"] - a["log_phi"], grad, hess


def fit_cox(df: DataFrame, duration: str, event: str, covariates: Sequence[str], max_steps: int = 30,
            tolerance: float = 1e-9) -> CoxModel:
    """Fit by Newton-Raphson with step halving. Rows with a missing value are dropped.

    A step that cannot be halved into an improvement is an error. ``converged`` tells whether the gradient vanished at finite
    coefficients: one standard deviation of a covariate that multiplies the hazard by more than exp(DIVERGING) counts as infinite.
    """
    p = len(covariates)
    x = df.select(F.col(duration).cast("double").alias("time"), F.col(event).cast("int").alias("event"),
                  *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(covariates)])
    x = x.dropna()
    st = x.agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("e"),
               *[F.avg(f"v{k}").alias(f"m{k}") for k in range(p)],
               *[F.stddev_samp(f"v{k}").alias(f"sd{k}") for k in range(p)]).first()
    if not st["n"] or not st["e"]:
        raise ValueError("no events to fit")
    means = np.array([st[f"m{k}"] for k in range(p)])
    scale = np.array([st[f"sd{k}"] or 1.0 for k in range(p)])
    rows = x.select("time", "event", *[((F.col(f"v{k}") - float(means[k])) / float(scale[k])).alias(f"x{k}")
                                       for k in range(p)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        beta = np.zeros(p)
        ll, grad, hess = _newton_terms(rows, beta, p)
        ll0, step_no, settled = ll, 0, False
        for step_no in range(1, max_steps + 1):
            step = np.linalg.solve(hess, grad)
            if float(grad @ step) < tolerance:
                settled = True
                break
            factor = 1.0
            while True:
                new = _newton_terms(rows, beta + factor * step, p)
                if new[0] >= ll - 1e-9 * max(1.0, abs(ll)):
                    break
                factor /= 2
                if factor < 1e-6:
                    raise ArithmeticError("no step in the Newton direction improves the likelihood")
            beta = beta + factor * step
            ll, grad, hess = new
        cov = np.linalg.inv(hess)
    finally:
        rows.unpersist()
    return CoxModel(tuple(covariates), tuple(map(float, beta / scale)), tuple(map(float, np.sqrt(np.diag(cov)) / scale)),
                    tuple(map(float, means)), float(ll), float(ll0), int(st["n"]), int(st["e"]), step_no,
                    settled and bool(np.abs(beta).max() < DIVERGING))


def cox_summary(df: DataFrame, duration: str, event: str, covariates: Sequence[str]) -> DataFrame:
    """(covariate, coef, exp_coef, std_err, lr_statistic, p, cind, cind_direct, n, n_events, converged).

    ``cind`` is the concordance of the fitted hazard (negated), ``cind_direct`` that of a single covariate itself.
    """
    complete = df.dropna(subset=[duration, event, *covariates])
    model = fit_cox(complete, duration, event, covariates)
    scored = complete.withColumn("__risk", -model.log_hazard())
    cind = concordance(scored, duration, event, "__risk").select("cind").scalar()
    spark = df.sparkSession
    rows = [(c, b, float(np.exp(b)), e, model.lr_statistic, model.p_value, model.n, model.n_events, model.converged)
            for c, b, e in zip(model.covariates, model.coef, model.std_err)]
    out = spark.createDataFrame(rows, "covariate string, coef double, exp_coef double, std_err double, "
                                      "lr_statistic double, p double, n long, n_events long, converged boolean").withColumn("cind", cind)
    if len(covariates) == 1:
        direct = concordance(complete, duration, event, covariates[0]).select("cind").scalar()
        return out.withColumn("cind_direct", direct)
    return out.withColumn("cind_direct", F.lit(None).cast("double"))


def baseline_hazard(df: DataFrame, model: CoxModel, duration: str, event: str) -> DataFrame:
    """(time, hazard, cumulative, place): Breslow baseline at every distinct time, numbered from 1."""
    t = df.groupBy(F.col(duration).cast("double").alias("time")).agg(
        F.sum(F.exp(model.log_hazard())).alias("r"), F.count_if(F.col(event) == 1).cast("double").alias("d"))
    t = ordered_scan(t, "time", [], ["r"], descending=True, keep_block=True).select(
        "time", BLOCK, (F.col("d") / F.col("cum_r")).alias("hazard"), F.lit(1).cast("long").alias("one"))
    t = ordered_scan(t, "time", [], ["hazard", "one"], block_expr=F.col(BLOCK), keep_block=True)
    return t.select("time", BLOCK, "hazard", F.col("cum_hazard").alias("cumulative"), F.col("cum_one").alias("place"))


#: Segments of the logarithm of the hazard, and Chebyshev nodes in each: far more than double precision needs.
WIDTH = 0.5
NODES = 20


def _chebyshev(values: np.ndarray) -> np.ndarray:
    """Coefficients from the values at the Chebyshev nodes."""
    n = values.shape[-1]
    angle = np.pi * (np.arange(n) + 0.5) / n
    c = values @ np.cos(np.outer(angle, np.arange(n))) * 2 / n
    c[..., 0] /= 2
    return c


def expected_lifetime(df: DataFrame, model: CoxModel, duration: str, event: str, id_col: str) -> DataFrame:
    """(id, expected): area under each row's survival curve over the distinct times, by the trapezoid rule.

    A row's curve depends on its hazard alone, smoothly, so no row meets the times. The logarithm of the hazard is cut into segments;
    the area is worked out over all times at a few Chebyshev nodes of those segments that rows lie in, as sums that Spark adds up over
    batches of times, and rows evaluate their segment's polynomial. Work is times x nodes + rows.
    """
    complete = df.dropna(subset=[duration, event, *model.covariates])
    rows = complete.select(F.col(id_col), model.log_hazard().alias("__eta"))
    rows = rows.withColumn("__seg", F.floor(F.col("__eta") / WIDTH))
    # exp(eta) is a double, so eta spans less than 1500 and there are fewer than 3000 segments
    segments = np.array(sorted(r[0] for r in rows.select("__seg").distinct().collect()), dtype=np.float64)
    point = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
    hazards = np.exp((segments[:, None] + 0.5 + point[None] / 2) * WIDTH).ravel()

    t = baseline_hazard(complete, model, duration, event).select("time", BLOCK, "hazard", F.lit(0).cast("long").alias("one"))
    steps = ordered_scan(t, "time", [], ["hazard"], next_cols=["time", "hazard"], block_expr=F.col(BLOCK)).where("next_time is not null")
    steps = steps.select((F.col("next_time") - F.col("time")).alias("width"), "cum_hazard", (F.col("cum_hazard") + F.col("next_hazard")).alias("next"))

    def areas(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(hazards))
        for pdf in frames:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a:a + 512]
                width, low, high = (part[c].to_numpy(np.float64) for c in ("width", "cum_hazard", "next"))
                total += width @ (np.exp(-np.outer(low, hazards)) + np.exp(-np.outer(high, hazards))) / 2
        yield pd.DataFrame({"k": np.arange(len(hazards)), "area": total})

    sums = steps.mapInPandas(areas, "k int, area double").groupBy("k").agg(F.sum("area").alias("area")).collect()
    value = np.zeros(len(hazards))
    for r in sums:
        value[r["k"]] = r["area"]
    table = [(int(s), [float(v) for v in c]) for s, c in zip(segments, _chebyshev(value.reshape(-1, NODES)))]
    known = df.sparkSession.createDataFrame(table, "__seg long, __c array<double>")
    x = (F.col("__eta") / WIDTH - F.col("__seg")) * 2 - 1
    zero = F.struct(F.lit(0.0).alias("b1"), F.lit(0.0).alias("b2"))
    clenshaw = F.aggregate(F.reverse(F.slice("__c", 2, NODES)), zero, lambda s, c: F.struct((c + 2 * x * s["b1"] - s["b2"]).alias("b1"), s["b1"].alias("b2")))
    out = rows.join(F.broadcast(known), "__seg").withColumn("__b", clenshaw)
    return out.select(id_col, (F.col("__c")[0] + x * F.col("__b.b1") - F.col("__b.b2")).alias("expected"))
