"""Queries on the survival table."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagframe.operators import cox as CX
from bagframe.operators import multiclass as M
from bagframe.operators import scan as SC
from bagframe.operators import survival as SV
from bagframe.operators.spec import CohortSpec, TrainType
from bagframe.plans import fixtures as fx
from bagframe.plans.oracle_parts import chi2_tail, cox_steps
from bagframe.plans.registry import query

KM = """select {g}, time, events, censored, sum(events + censored) over (partition by {g} order by time desc) as at_risk,
    sum(events + censored) over (partition by {g}) as total
  from (select {g}, duration as time, count(*) filter (event = 1) as events, count(*) filter (event = 0) as censored from surv group by {g}, duration)"""

# Pair counts by definition, over distinct (time, event, score) rows.
PAIRS = """select {g} as g, sum(i.n * j.n) as comparable, sum(case when i.s < j.s then i.n * j.n else 0 end) as concordant,
    sum(case when i.s = j.s then i.n * j.n else 0 end) as tied
  from rows_ i join rows_ j on i.g = j.g and i.event = 1 and (i.duration < j.duration or (i.duration = j.duration and j.event = 0)) group by {g}"""


@query("survival_curves", "grp:s time:d at_risk:l events:l censored:l survival:d cumulative_hazard:d",
       """select grp, time, at_risk, events, censored, case when bool_or(events = at_risk) over w then 0.0e0 else
            exp(sum(case when events < at_risk then ln(1 - events / cast(at_risk as double)) else 0.0e0 end) over w) end as survival,
            sum(events / cast(at_risk as double)) over w as cumulative_hazard
          from km window w as (partition by grp order by time rows between unbounded preceding and current row)
          union all select grp, 0.0e0, max(total), 0, 0, 1.0e0, 0.0e0 from km group by grp having min(time) > 0""", "surv", km=KM.format(g="grp"))
def _(spark, sf):
    """Kaplan-Meier and Nelson-Aalen curves per group with numbers at risk."""
    return SV.survival_curves(fx.surv(spark, sf), "duration", "event", ["grp"])


@query("event_labels", "grp:s label:s",
       "select grp, ' (' || cast(sum(event) as varchar) || '/' || cast(count(*) as varchar) || ' events)' as label from surv group by grp", "surv")
def _(spark, sf):
    return fx.surv(spark, sf).groupBy("grp").agg(SV.events_label("event").alias("label"))


LOGRANK = """select {g}, sum(d1 - d * r1 / r) as u, sum(case when r > 1 then d * (r1 / r) * (r2 / r) * (r - d) / (r - 1) else 0 end) as v from (
    select {g}, t.time, sum(case when s.arm = p.a and s.event = 1 and s.duration = t.time then 1 else 0 end) as d1,
      cast(sum(case when s.event = 1 and s.duration = t.time then 1 else 0 end) as double) as d,
      cast(sum(case when s.arm = p.a then 1 else 0 end) as double) as r1, cast(sum(case when s.arm = p.b then 1 else 0 end) as double) as r2, cast(count(*) as double) as r
    from pairs p join arms s on s.arm in (p.a, p.b) join (select distinct duration as time from surv where event = 1) t on s.duration >= t.time
    group by {g}, t.time) group by {g}"""


@query("logrank_tests", "a:s b:s statistic:d", "select a, b, u * u / v as statistic from lr", "surv",
       arms="select grp as arm, duration, event from surv",
       pairs="select x.arm as a, y.arm as b from (select distinct arm from arms) x join (select distinct arm from arms) y on x.arm < y.arm",
       lr=LOGRANK.format(g="a, b"))
def _(spark, sf):
    """Pairwise log-rank statistics between market segments."""
    return SV.logrank(fx.surv(spark, sf), "duration", "event", "grp")


@query("logrank_p_values", "a:s b:s p:d", f"select a, b, {chi2_tail('x')} as p from (select a, b, u * u / v as x from lr)", "surv",
       arms="select grp as arm, duration, event from surv",
       pairs="select x.arm as a, y.arm as b from (select distinct arm from arms) x join (select distinct arm from arms) y on x.arm < y.arm",
       lr=LOGRANK.format(g="a, b"))
def _(spark, sf):
    return SV.logrank(fx.surv(spark, sf), "duration", "event", "grp")


@query("concordance_index", "comparable:l concordant:l tied:l cind:d",
       "select comparable, concordant, tied, (concordant + tied / 2.0e0) / comparable as cind from pairs", "surv",
       rows_="select 1 as g, duration, event, marker as s, count(*) as n from surv group by all", pairs=PAIRS.format(g="i.g"))
def _(spark, sf):
    """Harrell's index of account balances, without forming pairs."""
    return SV.concordance(fx.surv(spark, sf), "duration", "event", "marker")


@query("concordance_by_group", "grp:s comparable:l concordant:l tied:l cind:d",
       "select g as grp, comparable, concordant, tied, (concordant + tied / 2.0e0) / comparable as cind from pairs", "surv",
       rows_="select grp as g, duration, event, nation as s, count(*) as n from surv group by all", pairs=PAIRS.format(g="i.g"))
def _(spark, sf):
    """Harrell's index per group for a score with many ties."""
    return SV.concordance(fx.surv(spark, sf), "duration", "event", "nation", ["grp"])


@query("survival_category_groups", "split:s level:s category_group:s n:l comparable:l concordant:l tied:l cind:d",
       """select g.split, g.level, g.category_group, g.n, coalesce(comparable, 0) as comparable, coalesce(concordant, 0) as concordant, coalesce(tied, 0) as tied,
            (concordant + tied / 2.0e0) / nullif(comparable, 0) as cind
          from (select split, level, category_group, count(*) as n from members group by all) g left join pairs p using (split, level, category_group)""", "surv",
       base="""select case when id % 3 = 0 then 'test' else 'train' end as split, grp as category, 'r' || cast(cast(nation as bigint) % 4 as varchar) as category2, duration, event, marker as s
              from surv""",
       names="select distinct category from base",
       members="""select split, 'all' as level, 'all' as category_group, duration, event, s from base
          union all select split, 'category', category, duration, event, s from base
          union all select split, 'category', a.category || '_' || b.category, duration, event, s from base
            join names a on true join names b on a.category < b.category and (base.category = a.category or base.category = b.category)
          union all select split, 'category2', category2, duration, event, s from base""",
       pairs="""select i.split, i.level, i.category_group, count(*) as comparable, count(*) filter (i.s < j.s) as concordant, count(*) filter (i.s = j.s) as tied
          from members i join members j on i.split = j.split and i.level = j.level and i.category_group = j.category_group and i.event = 1
            and (i.duration < j.duration or (i.duration = j.duration and j.event = 0)) group by all""")
def _(spark, sf):
    """Harrell's index of the whole table, of single categories and pairs of them on one level, and of those of a second level."""
    category2 = F.concat(F.lit("r"), (F.col("nation").cast("long") % 4).cast("string"))
    df = fx.surv(spark, sf).withColumns({"split": F.when(F.col("id") % 3 == 0, "test").otherwise("train"), "category": F.col("grp"), "category2": category2})
    spec = CohortSpec(TrainType.SURV, ("event", "duration"))
    return M.evaluate_survival(df, spec, "marker", {"": (1, 2), "2": (1,)}, ("", 2))


@query("marker_dichotomised", "name:s arm:l cutoff:d",
       "select name, cast(marker >= c as integer) as arm, c as cutoff from surv, (select median(marker) as c from surv)", "surv")
def _(spark, sf):
    """Median split of a marker."""
    return SV.dichotomise(fx.surv(spark, sf), "marker")


@query("marker_dichotomised_by_group", "name:s arm:l cutoff:d",
       "select name, case when lo < c then cast(nation >= c as integer) else cast(nation > c as integer) end as arm, c as cutoff from surv join (select grp, avg(nation) as c, min(nation) as lo from surv group by grp) using (grp)",
       "surv")
def _(spark, sf):
    """Split at the group mean."""
    return SV.dichotomise(fx.surv(spark, sf), "nation", cutoff="mean", group=["grp"])


@query("exact_quantiles", "l_returnflag:s q03:d q50:d q97:d",
       """select l_returnflag, quantile_cont(l_extendedprice, 0.03) as q03, quantile_cont(l_extendedprice, 0.5) as q50, quantile_cont(l_extendedprice, 0.97) as q97
          from lineitem group by l_returnflag""", digits=4)
def _(spark, sf):
    """Interpolated quantiles per group from ordered counts."""
    q = SC.exact_quantiles(fx.table(spark, sf, "lineitem"), "l_extendedprice", [0.03, 0.5, 0.97], ["l_returnflag"])
    return q.select("l_returnflag", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q03", "q50", "q97"))])


@query("running_totals", "l_shipdate:s cum:l total:l",
       """select cast(cast(l_shipdate as date) as varchar) as l_shipdate, sum(n) over (order by l_shipdate) as cum, sum(n) over () as total
          from (select l_shipdate, count(*) as n from lineitem group by l_shipdate)""")
def _(spark, sf):
    """Ordered running total over the whole table in blocks."""
    d = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    c = fx.table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("l_shipdate"), d.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return SC.ordered_scan(c, "day", [], ["n"]).select("l_shipdate", F.col("cum_n").alias("cum"), F.col("total_n").alias("total"))


@query("survival_report_by_group", "grp:s n:l n_events:l cind:d p:d",
       f"""select grp, n, n_events, cind, case when n_events > 0 and n_events < n then {chi2_tail('x')} else -1 end as p
          from (select grp, count(*) as n, sum(event) as n_events from surv group by grp)
          left join (select g as grp, (concordant + tied / 2.0e0) / comparable as cind from pairs) using (grp)
          left join (select grp, case when v > 0 then u * u / v end as x from lr) using (grp)""", "surv",
       rows_="select grp as g, duration, event, marker as s, count(*) as n from surv group by all", pairs=PAIRS.format(g="i.g"),
       cut="select grp, min(marker) as lo, quantile_cont(marker, 0.5) as mid from surv group by grp",
       arms="select grp, duration, event, cast(case when lo < mid then marker >= mid else marker > mid end as integer) as arm from surv join cut using (grp)",
       times="select distinct grp, duration as time from surv where event = 1",
       lr="""select grp, sum(d1 - d * r1 / r) as u, sum(case when r > 1 then d * (r1 / r) * (r2 / r) * (r - d) / (r - 1) else 0 end) as v from (
              select s.grp, t.time, sum(case when arm = 0 and event = 1 and duration = time then 1 else 0 end) as d1,
                cast(sum(case when event = 1 and duration = time then 1 else 0 end) as double) as d, cast(count(*) filter (arm = 0) as double) as r1,
                cast(count(*) filter (arm = 1) as double) as r2, cast(count(*) as double) as r
              from arms s join times t on s.grp = t.grp and s.duration >= t.time group by s.grp, t.time) group by grp""")
def _(spark, sf):
    """Concordance and median-split log-rank p per group."""
    return SV.survival_report(fx.surv(spark, sf), "duration", "event", "marker", ["grp"])


@query("survival_report_one_event_class", "n:l n_events:l cind:d p:d",
       "select max(n) as n, 0 as n_events, cast(null as double) as cind, -1 as p from (select count(*) as n from surv where event = 0)", "surv")
def _(spark, sf):
    """Only censored rows: no comparable pair, p is -1."""
    return SV.survival_report(fx.surv(spark, sf).where("event = 0"), "duration", "event", "marker")


@query("cox_loss", "grp:s loss:d",
       """select i.grp, (sum(i.d * (ln(r + 1e-7) + top)) - sum(i.se)) / sum(i.d) as loss from (
            select a.grp, a.duration, max(a.d) as d, max(a.se) as se, max(a.top) as top, sum(exp(b.s - a.top)) as r from (
              select grp, duration, sum(event) as d, sum(event * nation / 10) as se, max(max(nation / 10)) over (partition by grp) as top from surv group by grp, duration) a
            join (select grp, duration, nation / 10 as s from surv) b on a.grp = b.grp and b.duration >= a.duration group by a.grp, a.duration) i
          group by i.grp""", "surv")
def _(spark, sf):
    """Negative partial log-likelihood per event of a given score."""
    df = fx.surv(spark, sf).withColumn("s", F.col("nation") / 10)
    return SV.cox_loss(df, "duration", "event", "s", ["grp"])


@query("cox_fit", "covariate:s coef:d exp_coef:d lr_statistic:d p:d n:l n_events:l converged:b cind:d",
       """select unnest(['balance', 'nation']) as covariate, unnest([b1, b2]) as coef, exp(unnest([b1, b2])) as exp_coef, lr as lr_statistic, exp(-lr / 2) as p,
            n, n_events, true as converged, cind from b9, (select 2 * (s8.ll - s0.ll) as lr from s8, s0), (select count(*) as n, sum(ev) as n_events from cox),
            (select (concordant + tied / 2.0e0) / comparable as cind from pairs)""", "surv", digits=5,
       cox="select duration as t, event as ev, marker / 1000 as x1, nation as x2 from surv where duration is not null and marker is not null and nation is not null",
       **cox_steps("cox", 2),
       rows_="select 1 as g, t as duration, ev as event, -(b1 * x1 + b2 * x2) as s, count(*) as n from cox, b9 group by all", pairs=PAIRS.format(g="i.g"))
def _(spark, sf):
    """Proportional hazards fit with two covariates."""
    df = fx.surv(spark, sf).withColumn("balance", F.col("marker") / 1000)
    return CX.cox_summary(df, "duration", "event", ["balance", "nation"])


@query("cox_expected_lifetime", "id:l expected:d",
       """select id, sum((t1 - t) * (exp(-cumulative * h) + exp(-cumulative1 * h)) / 2) as expected from hazard, steps group by id""", "surv", digits=4,
       cox="select id, duration as t, event as ev, marker / 1000 as x1 from surv where duration is not null and marker is not null",
       **cox_steps("cox", 1),
       hazard="select id, t as own, ev, exp(b1 * (x1 - (select avg(x1) from cox))) as h from cox, b9",
       base="select t, sum(d / r) over (order by t) as cumulative from (select t, d, sum(r) over (order by t desc) as r from (select own as t, sum(h) as r, count(*) filter (ev = 1) as d from hazard group by own))",
       steps="select * from (select t, cumulative, lead(t) over (order by t) as t1, lead(cumulative) over (order by t) as cumulative1 from base) where t1 is not null")
def _(spark, sf):
    """Area under each row's predicted survival curve."""
    df = fx.surv(spark, sf).withColumn("balance", F.col("marker") / 1000)
    model = CX.fit_cox(df, "duration", "event", ["balance"])
    return CX.expected_lifetime(df, model, "duration", "event", "id")
