"""Pieces of DuckDB SQL that several counterparts share: tail probabilities, a Cox fit by Newton steps, merged boxes."""

from __future__ import annotations


def chi2_tail(x: str) -> str:
    """Upper tail of the chi-square distribution with one degree of freedom: 1 - erf by its series with positive terms."""
    term = f"exp((2 * k + 1) * ln(sqrt(({x}) / 2)) + 2 * k * ln(2.0e0) + lgamma(k + 1) - lgamma(2 * k + 2))"
    return (f"case when ({x}) > 70 then 0.0e0 when ({x}) <= 0 then 1.0e0 "
            f"when ({x}) is not null then 1 - 2 / sqrt(pi()) * exp(-({x}) / 2) * list_sum([{term} for k in range(0, 250)]) end")


def cox_steps(rows: str, covariates: int, steps: int = 9) -> dict[str, str]:
    """Subqueries of a Cox fit with Efron ties from ``rows`` (t, ev, x1, x2..): b0.. the coefficients, s0.. the sums of each step.
    One or two covariates."""
    ks = range(1, covariates + 1)
    pairs = [(i, j) for i in ks for j in ks if i <= j]
    names = ["", *[str(i) for i in ks], *[f"{i}{j}" for i, j in pairs]]
    factor = {"": "1", **{str(i): f"x{i}" for i in ks}, **{f"{i}{j}": f"x{i} * x{j}" for i, j in pairs}}
    out = {"b0": "select " + ", ".join(f"0.0e0 as b{i}" for i in ks)}
    for s in range(steps):
        eta = " + ".join(f"b{i} * x{i}" for i in ks)
        sums = ", ".join(f"sum({factor[n]} * e) as r{n}, sum(case when ev = 1 then {factor[n]} * e else 0 end) as d{n}" for n in names)
        out[f"a{s}"] = (f"select t, count(*) filter (ev = 1) as m, sum(case when ev = 1 then eta else 0 end) as eta, "
                        + ", ".join(f"sum(case when ev = 1 then x{i} else 0 end) as s{i}" for i in ks)
                        + f", {sums} from (select *, {eta} as eta, exp({eta}) as e from {rows}, b{s}) group by t")
        out[f"c{s}"] = "select *, " + ", ".join(f"sum(r{n}) over (order by t desc) as q{n}" for n in names) + f" from a{s}"
        out[f"g{s}"] = (f"select eta / m as eta, " + ", ".join(f"s{i} / m as s{i}" for i in ks) + ", "
                        + ", ".join(f"q{n} - l / cast(m as double) * d{n} as p{n}" for n in names) + f" from (select *, unnest(range(0, m)) as l from c{s} where m > 0)")
        out[f"s{s}"] = ("select sum(eta - ln(p)) as ll, " + ", ".join(f"sum(s{i} - p{i} / p) as u{i}" for i in ks) + ", "
                        + ", ".join(f"sum(p{i}{j} / p - p{i} / p * p{j} / p) as h{i}{j}" for i, j in pairs) + f" from g{s}")
        if covariates == 1:
            step = ["u1 / h11"]
        else:
            step = ["(h22 * u1 - h12 * u2) / (h11 * h22 - h12 * h12)", "(h11 * u2 - h12 * u1) / (h11 * h22 - h12 * h12)"]
        out[f"b{s + 1}"] = "select " + ", ".join(f"b{i} + {e} as b{i}" for i, e in zip(ks, step)) + f" from b{s}, s{s}"
    return out


def merged_boxes(boxes: str, rounds: int = 6) -> tuple[str, dict[str, str]]:
    """(name of the last table, subqueries): strictly overlapping boxes (file, id, x0, y0, x1, y1) replaced by hulls, round by round."""
    out, now = {}, boxes
    for r in range(rounds):
        out[f"link{r}"] = (f"select a.file, a.id as a, b.id as b from {now} a join {now} b on a.file = b.file and greatest(a.x0, b.x0) < least(a.x1, b.x1) "
                           "and greatest(a.y0, b.y0) < least(a.y1, b.y1)")
        out[f"reach{r}"] = f"select file, a, b from link{r} union select x.file, x.a, y.b from reach{r} x join link{r} y on x.file = y.file and x.b = y.a"
        out[f"root{r}"] = f"select file, a as id, min(b) as root from reach{r} group by all"
        out[f"box{r}"] = (f"select file, root as id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from {now} join root{r} using (file, id) group by file, root")
        now = f"box{r}"
    return now, out
