"""Queries on prediction tables: binary, multiclass, multilabel, regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagframe.functions import labels as L
from bagframe.operators import binary as B
from bagframe.operators import cohort as C
from bagframe.operators import groups as G
from bagframe.operators import multiclass as M
from bagframe.operators import predict as P
from bagframe.operators import profile as PR
from bagframe.operators.permute import permutation_sql
from bagframe.operators.spec import CohortSpec, TrainType
from bagframe.plans import fixtures as fx
from bagframe.plans.oracle_parts import chi2_tail
from bagframe.plans.registry import query

BINARY = CohortSpec(TrainType.CLF, ("Neg", "Pos"))
THREE = CohortSpec(TrainType.CLF, ("c0", "c1", "c2"))
MULTI = CohortSpec(TrainType.MULTILABEL, ("other", "quality", "toxic"))

# One row per (group key g, distinct score) with cumulative counts from the highest score down.
SCAN = """select *, sum(pos) over w as tps, sum(neg) over w as fps, sum(pos) over (partition by {g}) as p,
    sum(neg) over (partition by {g}) as n, lead(pos) over (partition by {g} order by score desc) as np,
    lead(neg) over (partition by {g} order by score desc) as nn,
    row_number() over (partition by {g} order by score desc) as rn
  from {counts} window w as (partition by {g} order by score desc rows between unbounded preceding and current row)"""

# ROC points after dropping equally spaced collinear ones, with the starting point.
ROC = """select {g}, score as threshold, tps, fps, p, n from {scan} where rn = 1 or np is null or np <> pos or nn <> neg
  union all select {g}, case when score < 1 then 1.0e0 else cast('infinity' as double) end, 0, 0, p, n from {scan} where rn = 1"""

AUC = """select {g}, sum(neg * (tps - pos / 2.0e0)) / nullif(max(cast(p as double) * n), 0) as auc from {scan} group by {g}"""

BEST = """select {g}, max({{'c': round(sqrt((tps / cast(p as double)) * (1 - fps / cast(n as double))), 12), 't': threshold}}).t
    as threshold from {roc} where p > 0 and n > 0 group by {g}"""

BINARY_METRICS = """
  coalesce(2.0e0 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, (tp + tn) / cast(tp + tn + fp + fn as double) as acc,
  case when tp + fn > 0 and tn + fp > 0 then (tp / cast(tp + fn as double) + tn / cast(tn + fp as double)) / 2
       when tp + fn > 0 then tp / cast(tp + fn as double) when tn + fp > 0 then tn / cast(tn + fp as double) end as bacc,
  coalesce(tp / nullif(cast(tp + fn as double), 0), 0) as tpr, fp / nullif(cast(tn + fp as double), 0) as fpr,
  tn / nullif(cast(tn + fp as double), 0) as tnr, fn / nullif(cast(tp + fn as double), 0) as fnr,
  tp + tn + fp + fn as n, tp + fn as n_pos,
  ((tp + tn) / cast(tp + tn + fp + fn as double)
    - ((tp + fn) * cast(tp + fp as double) + (tn + fp) * cast(tn + fn as double)) / power(tp + tn + fp + fn, 2))
  / nullif(1 - ((tp + fn) * cast(tp + fp as double) + (tn + fp) * cast(tn + fn as double)) / power(tp + tn + fp + fn, 2), 0) as kappa"""

# Yates-corrected chi-square of [[a, b], [c, d]].
CHI2 = """case when (a + b) * (c + d) * (a + c) * (b + d) = 0 then 0.0e0 else
  {t1} + {t2} + {t3} + {t4} end"""


def _term(o: str, r: str, c: str) -> str:
    e = f"(({r}) * cast(({c}) as double) / (a + b + c + d))"
    return f"power(abs({o} - {e}) - least(0.5e0, abs({o} - {e})), 2) / {e}"


CHI2 = CHI2.format(t1=_term("a", "a + b", "a + c"), t2=_term("b", "a + b", "b + d"), t3=_term("c", "c + d", "a + c"),
                   t4=_term("d", "c + d", "b + d"))

COUNTS = "select {g}, out1 as score, count(*) filter (Pos = 1) as pos, count(*) filter (Pos = 0) as neg from preds group by {g}, out1"


def binary_steps(g: str, counts: str) -> dict[str, str]:
    return {"counts": counts, "scan": SCAN.format(g=g, counts="counts"), "roc": ROC.format(g=g, scan="scan"),
            "aucs": AUC.format(g=g, scan="scan")}


REPORT_SQL = """
  select split, threshold, tn, fp, fn, tp, auc, {metrics}, {chi2} as chi2 from (
    select c.split, max(t.threshold) as threshold,
      sum(case when score < threshold then neg else 0 end) as tn, sum(case when score >= threshold then neg else 0 end) as fp,
      sum(case when score < threshold then pos else 0 end) as fn, sum(case when score >= threshold then pos else 0 end) as tp,
      sum(case when score <= threshold then neg else 0 end) as a, sum(case when score > threshold then neg else 0 end) as b,
      sum(case when score <= threshold then pos else 0 end) as c, sum(case when score > threshold then pos else 0 end) as d
    from counts c, (select threshold from best where split = 'validation') t group by c.split) x join aucs using (split)"""


@query("binary_report_by_split",
       "split:s threshold:d auc:d tn:l fp:l fn:l tp:l n:l n_pos:l f1:d acc:d bacc:d tpr:d fpr:d tnr:d fnr:d kappa:d chi2:d p_thresh:d",
       f"select *, {chi2_tail('chi2')} as p_thresh from (" + REPORT_SQL.format(metrics=BINARY_METRICS, chi2=CHI2) + ")", "preds",
       **binary_steps("split", COUNTS.format(g="split")), best=BEST.format(g="split", roc="roc"))
def _(spark, sf):
    """AUC, validation threshold reused on all splits, confusion metrics, chi-square."""
    return B.binary_report(fx.preds(spark, sf), "Pos", "out1", ["split"], threshold_from=F.col("split") == "validation")


@query("chi_square_p_value", "split:s statistic:d p:d",
       f"""select *, {chi2_tail('statistic')} as p from (select split, {CHI2} as statistic from (
         select split, count(*) filter (Pos = 0 and out1 <= 0.5) as a, count(*) filter (Pos = 0 and out1 > 0.5) as b,
           count(*) filter (Pos = 1 and out1 <= 0.5) as c, count(*) filter (Pos = 1 and out1 > 0.5) as d from preds group by split))""", "preds")
def _(spark, sf):
    """p-values of target against (score > 0.5)."""
    return B.chi_square_test(fx.preds(spark, sf), "Pos", "out1", 0.5, ["split"])


@query("chi_square_contingency", "split:s no_low:l no_high:l yes_low:l yes_high:l statistic:d",
       f"""select split, a as no_low, b as no_high, c as yes_low, d as yes_high, {CHI2} as statistic from (
         select split, count(*) filter (Pos = 0 and out1 <= 0.5) as a, count(*) filter (Pos = 0 and out1 > 0.5) as b,
           count(*) filter (Pos = 1 and out1 <= 0.5) as c, count(*) filter (Pos = 1 and out1 > 0.5) as d
         from preds group by split)""", "preds")
def _(spark, sf):
    """Contingency table and Yates-corrected statistic."""
    return B.chi_square_test(fx.preds(spark, sf), "Pos", "out1", 0.5, ["split"])


@query("roc_auc_by_split", "split:s auc:d n_pos:l n:l",
       """select split, (sum(case when Pos = 1 then r end) - p * (p + 1) / 2.0e0) / (p * cast(c - p as double)) as auc,
            p as n_pos, c as n
          from (select *, rank() over (partition by split order by out1)
                  + (count(*) over (partition by split, out1) - 1) / 2.0e0 as r,
                  sum(Pos) over (partition by split) as p, count(*) over (partition by split) as c from preds)
          group by split, p, c""", "preds")
def _(spark, sf):
    """AUC from score counts; the SQL side uses midranks."""
    return B.roc_auc(fx.preds(spark, sf), "Pos", "out1", ["split"])


@query("midranks", "split:s out1:d n:l midrank:d",
       """select distinct split, out1, count(*) over (partition by split, out1) as n,
            rank() over (partition by split order by out1) + (count(*) over (partition by split, out1) - 1) / 2.0e0 as midrank
          from preds""", "preds")
def _(spark, sf):
    return B.midranks(fx.preds(spark, sf), "out1", ["split"])


@query("roc_auc_many_rows", "l_returnflag:s auc:d n:l",
       """select l_returnflag, (sum(case when y = 1 then r end) - max(p) * (max(p) + 1) / 2.0e0)
              / (max(p) * cast(count(*) - max(p) as double)) as auc, count(*) as n
          from (select l_returnflag, y, rank() over (partition by l_returnflag order by l_extendedprice)
                  + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0e0 as r,
                  sum(y) over (partition by l_returnflag) as p
                from (select *, case when l_quantity > 25 then 1 else 0 end as y from lineitem))
          group by l_returnflag""")
def _(spark, sf):
    """AUC of a price for large quantities, over all line items."""
    df = fx.table(spark, sf, "lineitem").withColumn("y", (F.col("l_quantity") > 25).cast("int"))
    return B.roc_auc(df, "y", "l_extendedprice", ["l_returnflag"])


@query("auc_by_predictor", "split:s predictor:s auc:d",
       """select split, predictor, (sum(case when Pos = 1 then r end) - max(p) * (max(p) + 1) / 2.0e0)
              / (max(p) * cast(count(*) - max(p) as double)) as auc
          from (select *, rank() over (partition by split, predictor order by s)
                  + (count(*) over (partition by split, predictor, s) - 1) / 2.0e0 as r,
                  sum(Pos) over (partition by split, predictor) as p
                from (select split, Pos, 'out0' as predictor, out0 as s from preds
                      union all select split, Pos, 'out1', out1 from preds))
          group by split, predictor""", "preds")
def _(spark, sf):
    """One AUC per score column."""
    return B.auc_by_predictor(fx.preds(spark, sf), "Pos", ["out0", "out1"], ["split"])


@query("roc_curve_points", "split:s threshold:d tps:l fps:l tpr:d fpr:d",
       "select split, threshold, tps, fps, tps / cast(p as double) as tpr, fps / cast(n as double) as fpr from roc", "preds",
       **binary_steps("split", COUNTS.format(g="split")))
def _(spark, sf):
    """ROC table with dropped collinear points and the starting threshold."""
    return B.roc_curve(fx.preds(spark, sf), "Pos", "out1", ["split"])


@query("roc_curve_full", "split:s threshold:d tpr:d fpr:d",
       """select split, score as threshold, tps / cast(p as double) as tpr, fps / cast(n as double) as fpr from scan
          union all select split, 1.0e0, 0, 0 from scan where rn = 1""", "preds",
       **binary_steps("split", COUNTS.format(g="split")))
def _(spark, sf):
    """Every ROC point."""
    return B.roc_curve(fx.preds(spark, sf), "Pos", "out1", ["split"], drop_intermediate=False)


_CRIT = """select split, 'gmean' as kind, sqrt(tpr * (1 - fpr)) as c, threshold from pts
  union all select split, 'gmean_w2', exp((2 / 3.0e0) * ln(tpr + 1e-12) + (1 - 2 / 3.0e0) * ln(1 - fpr + 1e-12)), threshold from pts
  union all select split, 'youden', tpr - fpr, threshold from pts
  union all select split, 'youden_w2', 2 * ((2 / 3.0e0) * tpr + (1 - 2 / 3.0e0) * (1 - fpr)) - 1, threshold from pts"""


@query("best_thresholds", "split:s kind:s threshold:d criterion:d",
       """select split, kind, b.t as threshold, b.c as criterion from (
            select split, kind, max({'c': round(c, 12), 't': threshold}) as b from crit group by split, kind)""", "preds",
       **binary_steps("split", COUNTS.format(g="split")),
       pts="select split, threshold, tps / cast(p as double) as tpr, fps / cast(n as double) as fpr from roc", crit=_CRIT)
def _(spark, sf):
    """Optimal cut-offs by g-mean and Youden, plain and with sensitivity weight 2."""
    roc = B.roc_curve(fx.preds(spark, sf), "Pos", "out1", ["split"])
    out = None
    for kind, crit, w in (("gmean", "gmean", None), ("gmean_w2", "gmean", 2.0), ("youden", "youden", None),
                          ("youden_w2", "youden", 2.0)):
        t = B.best_threshold(roc, ["split"], crit, w).withColumn("kind", F.lit(kind))
        out = t if out is None else out.unionByName(t)
    return out


@query("threshold_predictions", "name:s pred:l", "select name, case when out1 >= 0.461 then 1 else 0 end as pred from preds", "preds")
def _(spark, sf):
    return fx.preds(spark, sf).withColumn("pred", B.threshold_scores("out1", 0.461))


@query("binary_confusion_metrics", "category:s tn:l fp:l fn:l tp:l f1:d acc:d bacc:d tpr:d fpr:d tnr:d fnr:d kappa:d n:l n_pos:l",
       f"""select category, tn, fp, fn, tp, {BINARY_METRICS} from (select category,
             count(*) filter (Pos = 0 and out1 < 0.5) as tn, count(*) filter (Pos = 0 and out1 >= 0.5) as fp,
             count(*) filter (Pos = 1 and out1 < 0.5) as fn, count(*) filter (Pos = 1 and out1 >= 0.5) as tp
           from preds group by category)""", "preds")
def _(spark, sf):
    """Confusion counts and their metrics per category."""
    df = fx.preds(spark, sf).withColumn("p", B.threshold_scores("out1", 0.5))
    cm = B.confusion_counts(df, "Pos", "p", ["category"])
    return cm.select("category", "tn", "fp", "fn", "tp", *B.binary_scores())


@query("calibration_curve", "split:s bin:l mean_predicted:d fraction_positive:d n:l",
       """select split, (out1 > 0.1)::int + (out1 > 0.2)::int + (out1 > 0.3e0)::int + (out1 > 0.4)::int + (out1 > 0.5)::int
            + (out1 > 0.6)::int + (out1 > 0.7)::int + (out1 > 0.8)::int + (out1 > 0.9)::int as bin,
            avg(out1) as mean_predicted, avg(cast(Pos as double)) as fraction_positive, count(*) as n
          from preds group by 1, 2""", "preds")
def _(spark, sf):
    """Reliability table with ten uniform bins."""
    return B.calibration(fx.preds(spark, sf), "Pos", "out1", ["split"])


@query("brier_score", "split:s brier:d", "select split, avg(power(out1 - Pos, 2)) as brier from preds group by split", "preds")
def _(spark, sf):
    return fx.preds(spark, sf).groupBy("split").agg(B.brier_score("Pos", "out1").alias("brier"))


HASH15 = "cast('0x' || substr(md5({text}), 1, 15) as bigint)"
SLOT = f"row_number() over (order by {HASH15.format(text="'order:' || name")}, name) - 1 as slot"


@query("auc_permutation_test", "auc:d n:l permutations:l p:d",
       """select (select sum(case when Pos = 1 then r end) - max(p) * (max(p) + 1) / 2.0e0 from ranked)
              / (select max(p) * cast(count(*) - max(p) as double) from ranked) as auc,
            (select count(*) from ranked) as n, 2000 as permutations,
            ((select count(*) from (select k, sum(b.r) as s from drawn d join ranked b on b.slot = d.partner group by k)
              where s >= (select sum(case when Pos = 1 then r end) from ranked)) + 1) / 2001.0e0 as p""", "preds",
       ranked=f"""select name, Pos, rank() over (order by out1) + (count(*) over (partition by out1) - 1) / 2.0e0 as r,
              sum(Pos) over () as p, {SLOT} from preds""",
       positive="select slot from ranked where Pos = 1",
       drawn=permutation_sql("positive", "1 as one", "(select count(*) from ranked)", 2000))
def _(spark, sf):
    """Permutation p-value of the AUC with 2000 permutations; a keyed bijection of the rows decides the permutations on both sides."""
    return B.auc_permutation_test(fx.preds(spark, sf), "Pos", "out1", "name")


@query("correlation_permutation_test", "score:d n:l permutations:l p:d",
       """select score, n, 2000 as permutations, ((select count(*) from (select k, corr(d.y, b.out1) as s from drawn d join base b on b.slot = d.partner group by k)
              where round(s, 12) >= round(score, 12)) + 1) / 2001.0e0 as p
          from (select corr(y, out1) as score, count(*) as n from base)""", "preds",
       base=f"select name, cast(Pos as double) as y, out1, {SLOT} from preds",
       drawn=permutation_sql("base", "y", "(select count(*) from base)", 2000))
def _(spark, sf):
    """Permutation test of a user statistic given as an aggregate expression."""
    df = fx.preds(spark, sf).withColumn("y", F.col("Pos").cast("double"))
    return B.permutation_test(df, "y", "out1", "name", F.corr)


# ---------------------------------------------------------------- multiclass

THREE_LONG = """select split, 'c0' as class, c0 as t, out0 as s from preds3 union all select split, 'c1', c1, out1 from preds3
  union all select split, 'c2', c2, out2 from preds3"""


@query("class_thresholds", "class:s threshold:d",
       "select class, threshold from best", "preds3",
       long3=f"select * from ({THREE_LONG}) where split = 'validation'",
       **binary_steps("class", "select class, s as score, count(*) filter (t = 1) as pos, count(*) filter (t = 0) as neg from long3 group by class, s"),
       best=BEST.format(g="class", roc="roc"))
def _(spark, sf):
    """Cut-off of every class against the rest, found on validation."""
    return M.class_thresholds(fx.preds3(spark, sf), THREE)


@query("class_report", "split:s class:s threshold:d tn:l fp:l fn:l tp:l auc:d",
       """select c.split, c.class, max(threshold) as threshold,
            count(*) filter (t = 0 and s < threshold) as tn, count(*) filter (t = 0 and s >= threshold) as fp,
            count(*) filter (t = 1 and s < threshold) as fn, count(*) filter (t = 1 and s >= threshold) as tp, max(a.auc) as auc
          from long3 c join best on c.class = best.class join auc2 a on a.split = c.split and a.class = c.class
          group by c.split, c.class""", "preds3", long3=THREE_LONG,
       **binary_steps("class", "select class, s as score, count(*) filter (t = 1) as pos, count(*) filter (t = 0) as neg from long3 where split = 'validation' group by class, s"),
       best=BEST.format(g="class", roc="roc"),
       auc2="""select split, class, (sum(case when t = 1 then r end) - max(p) * (max(p) + 1) / 2.0e0)
              / (max(p) * cast(count(*) - max(p) as double)) as auc
            from (select *, rank() over (partition by split, class order by s)
                + (count(*) over (partition by split, class, s) - 1) / 2.0e0 as r,
                sum(t) over (partition by split, class) as p from long3) group by split, class""")
def _(spark, sf):
    """One-vs-rest report with validation thresholds reused on every split."""
    return M.class_report(fx.preds3(spark, sf), THREE)


@query("macro_auc", "split:s auc:d",
       """select split, avg(auc) as auc from (select split, class, (sum(case when t = 1 then r end) - max(p) * (max(p) + 1) / 2.0e0)
              / (max(p) * cast(count(*) - max(p) as double)) as auc
            from (select *, rank() over (partition by split, class order by s)
                + (count(*) over (partition by split, class, s) - 1) / 2.0e0 as r,
                sum(t) over (partition by split, class) as p from long3) group by split, class) group by split""",
       "preds3", long3=THREE_LONG)
def _(spark, sf):
    df = fx.preds3(spark, sf)
    auc = B.auc_from_scan(B.scan_scores(M.class_counts(df, THREE, ["split"]), ["split", "class"]), ["split", "class"])
    return M.macro_auc(auc, ["split"])


ARGMAX3 = "case when out0 >= out1 and out0 >= out2 then 0 when out1 >= out2 then 1 else 2 end"
CM3 = f"""select split, y_true, y_pred, coalesce(n, 0) as n from (select distinct split from preds3),
  (select unnest([0,1,2]) as y_true), (select unnest([0,1,2]) as y_pred)
  left join (select split as s, y as a, {ARGMAX3} as b, count(*) as n from preds3 group by all) on s = split and a = y_true and b = y_pred"""


@query("confusion_matrix", "split:s y_true:l y_pred:l n:l", CM3, "preds3")
def _(spark, sf):
    """All k x k cells, absent ones included."""
    return M.confusion_matrix(fx.preds3(spark, sf), "y", L.argmax(THREE.out_cols), 3, ["split"])


@query("confusion_matrix_normalised", "split:s y_true:l y_pred:l share:d",
       "select split, y_true, y_pred, coalesce(n / nullif(cast(sum(n) over (partition by split, y_true) as double), 0), 0) as share from cm",
       "preds3", cm=CM3)
def _(spark, sf):
    return M.normalise_matrix(M.confusion_matrix(fx.preds3(spark, sf), "y", L.argmax(THREE.out_cols), 3, ["split"]), ["split"])


PER3 = """select r.split, r.c as class, row_n, col_n, tp, total from
  (select split, y_true as c, sum(n) as row_n, sum(case when y_true = y_pred then n else 0 end) as tp from cm group by all) r
  join (select split, y_pred as c, sum(n) as col_n from cm group by all) k on k.split = r.split and k.c = r.c
  join (select split, sum(n) as total from cm group by split) t on t.split = r.split"""


@query("matrix_class_metrics", "split:s class:l support:l f1:d precision:d tpr:d tnr:d",
       """select split, class, row_n as support, 2.0e0 * tp / nullif(row_n + col_n, 0) as f1,
            tp / nullif(cast(col_n as double), 0) as precision, tp / nullif(cast(row_n as double), 0) as tpr,
            (total - row_n - col_n + tp) / nullif(cast(total - row_n as double), 0) as tnr from per""",
       "preds3", cm=CM3, per=PER3)
def _(spark, sf):
    return M.matrix_class_metrics(M.confusion_matrix(fx.preds3(spark, sf), "y", L.argmax(THREE.out_cols), 3, ["split"]), ["split"])


@query("matrix_metrics", "split:s n:l acc:d kappa:d kappa_quadratic:d f1_macro:d f1_micro:d f1_weighted:d fleiss:s",
       """select split, n, acc, kappa, kappa_quadratic, f1_macro, acc as f1_micro, f1_weighted,
            case when kappa < 0.4 then 'Poor' when kappa < 0.75 then 'Intermediate to Good' else 'Excellent' end as fleiss
          from (select split, max(total) as n, sum(tp) / cast(max(total) as double) as acc,
              (sum(tp) / cast(max(total) as double) - sum(row_n * col_n) / power(max(total), 2))
                / (1 - sum(row_n * col_n) / power(max(total), 2)) as kappa,
              avg(2.0e0 * tp / nullif(row_n + col_n, 0)) as f1_macro,
              sum(row_n * (2.0e0 * tp / nullif(row_n + col_n, 0))) / max(total) as f1_weighted from per group by split)
          join (select cm.split, 1 - sum(power(y_true - y_pred, 2) * n) * max(a.total)
                / sum(power(y_true - y_pred, 2) * cast(a.row_n as double) * b.col_n) as kappa_quadratic
              from cm join per a on a.split = cm.split and a.class = y_true join per b on b.split = cm.split and b.class = y_pred
              group by cm.split) using (split)""", "preds3", cm=CM3, per=PER3)
def _(spark, sf):
    """Accuracy, kappas and F1 variants of the matrix, with the verbal kappa band."""
    return M.matrix_metrics(M.confusion_matrix(fx.preds3(spark, sf), "y", L.argmax(THREE.out_cols), 3, ["split"]), ["split"])


# ---------------------------------------------------------------- multilabel

ML_LONG = """select name, split, 'other' as class, other as t, out0 as s from preds_ml
  union all select name, split, 'quality', quality, out1 from preds_ml union all select name, split, 'toxic', toxic, out2 from preds_ml"""
ML_STEPS = dict(longm=ML_LONG, **binary_steps(
    "class", "select class, s as score, count(*) filter (t = 1) as pos, count(*) filter (t = 0) as neg from longm where split = 'validation' group by class, s"),
    best=BEST.format(g="class", roc="roc"),
    hot="select l.*, case when s >= threshold then 1 else 0 end as p from longm l join best using (class)")


def _ml(spark, sf):
    df = fx.preds_ml(spark, sf)
    return M.multilabel_predictions(df, MULTI, M.class_thresholds(df, MULTI))


@query("multilabel_matrices", "split:s class:s tn:l fp:l fn:l tp:l",
       """select split, class, count(*) filter (t = 0 and p = 0) as tn, count(*) filter (t = 0 and p = 1) as fp,
            count(*) filter (t = 1 and p = 0) as fn, count(*) filter (t = 1 and p = 1) as tp from hot group by split, class""",
       "preds_ml", **ML_STEPS)
def _(spark, sf):
    """2 x 2 matrix per class, every class thresholded by its own validation cut-off."""
    return M.multilabel_matrices(_ml(spark, sf), MULTI, ["split"])


@query("multilabel_metrics", "split:s n:l acc:d f1_micro:d f1_macro:d f1_weighted:d",
       """select split, n, acc, f1_micro, f1_macro, f1_weighted from (select split, 2.0e0 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0) as f1_micro,
              avg(coalesce(2.0e0 * tp / nullif(2 * tp + fp + fn, 0), 0)) as f1_macro,
              sum((tp + fn) * coalesce(2.0e0 * tp / nullif(2 * tp + fp + fn, 0), 0)) / sum(tp + fn) as f1_weighted
            from (select split, class, count(*) filter (t = 0 and p = 1) as fp, count(*) filter (t = 1 and p = 0) as fn,
                count(*) filter (t = 1 and p = 1) as tp from hot group by split, class) group by split)
          join (select split, count(*) as n, avg(ok) as acc from (select split, name, cast(bool_and(t = p) as integer) as ok
              from hot group by split, name) group by split) using (split)""", "preds_ml", **ML_STEPS)
def _(spark, sf):
    """Subset accuracy and F1 variants."""
    return M.multilabel_metrics(_ml(spark, sf), MULTI, ["split"])


@query("highest_label_matrix", "split:s y_true:l y_pred:l n:l",
       """select split, y_true, y_pred, coalesce(n, 0) as n from (select distinct split from preds_ml),
            (select unnest([0,1,2]) as y_true), (select unnest([0,1,2]) as y_pred)
          left join (select split as s, a, b, count(*) as n from (select split, name,
              coalesce(max(case when t = 1 then k end), 2) as a, coalesce(max(case when p = 1 then k end), 2) as b
            from (select *, case class when 'other' then 0 when 'quality' then 1 else 2 end as k from hot) group by split, name)
            group by all) on s = split and a = y_true and b = y_pred""", "preds_ml", **ML_STEPS)
def _(spark, sf):
    """Multilabel read as multiclass by the highest class."""
    return M.highest_label_matrix(_ml(spark, sf), MULTI, ["split"])


@query("category_prediction_matrix", "category:s label:l Neg:l Pos:l",
       """select category, max(y) as label, count(*) filter (p = 0) as Neg, count(*) filter (p = 1) as Pos from (
            select case when Pos = 1 then 'cat_pos' else 'cat_neg' end as category, Pos as y,
              case when out1 > out0 then 1 else 0 end as p from preds) group by category""", "preds")
def _(spark, sf):
    """Category x predicted class when every category has one true class."""
    df = fx.preds(spark, sf).withColumn("category", F.when(F.col("Pos") == 1, "cat_pos").otherwise("cat_neg"))
    df = df.withColumn("p", L.argmax(BINARY.out_cols))
    return M.category_prediction_matrix(df, BINARY, "p")


@query("regression_metrics", "split:s n:l mse:d rmse:d r2:d",
       """select split, count(*) as n, avg(power(n_chars / 1000.0e0 - out1, 2)) as mse, sqrt(avg(power(n_chars / 1000.0e0 - out1, 2))) as rmse,
            1 - avg(power(n_chars / 1000.0e0 - out1, 2)) / var_pop(n_chars / 1000.0e0) as r2
          from (select preds.split, out1, n_chars from preds join cohort using (name)) group by split""", "preds", digits=5)
def _(spark, sf):
    """mse, rmse and r2 of a score against text length in thousands."""
    c = fx.cohort(spark, sf).select("name", (F.col("n_chars") / 1000.0).alias("y"))
    return M.regression_metrics(fx.preds(spark, sf).join(c, "name"), ["y"], ["out1"], ["split"])


@query("evaluation_losses", "split:s bce:d cross_entropy:d",
       """select split, avg((b0 * 1 + b1 * 2 + b2 * 0.5e0) / 3) as bce, sum(ce * w) / sum(w) as cross_entropy from (
            select split, greatest(logit0, 0) - logit0 * c0 + ln(1 + exp(-abs(logit0))) as b0,
              greatest(logit1, 0) - logit1 * c1 + ln(1 + exp(-abs(logit1))) as b1,
              greatest(logit2, 0) - logit2 * c2 + ln(1 + exp(-abs(logit2))) as b2,
              -ln(case y when 0 then out0 when 1 then out1 else out2 end) as ce,
              case y when 0 then 1.0e0 when 1 then 2.0e0 else 0.5e0 end as w from preds3) group by split""", "preds3")
def _(spark, sf):
    """Weighted cross-entropy and BCE-with-logits as evaluation losses."""
    return M.evaluation_losses(fx.preds3(spark, sf), ["logit0", "logit1", "logit2"], ["c0", "c1", "c2"], "y",
                               [1.0, 2.0, 0.5], ["split"])


@query("mse_loss", "split:s mse:d", "select split, avg(power(Pos - out1, 2)) as mse from preds group by split", "preds")
def _(spark, sf):
    return M.regression_metrics(fx.preds(spark, sf), ["Pos"], ["out1"], ["split"])


@query("grouped_class_auc", "split:s auc:d",
       """select split, (sum(case when t = 1 then r end) - max(p) * (max(p) + 1) / 2.0e0)
            / (max(p) * cast(count(*) - max(p) as double)) as auc from (select *, rank() over (partition by split order by z)
              + (count(*) over (partition by split, z) - 1) / 2.0e0 as r, sum(t) over (partition by split) as p
            from (select split, logit1 + 2 * logit2 as z, case when c1 + 2 * c2 > 0 then 1 else 0 end as t from preds3))
          group by split""", "preds3")
def _(spark, sf):
    """Abnormal-versus-normal score: weighted logits against any weighted class."""
    df = M.grouped_class_scores(fx.preds3(spark, sf), ["logit0", "logit1", "logit2"], ["c0", "c1", "c2"], [0, 1, 2])
    return B.roc_auc(df, "group_target", "group_logit", ["split"])


# ---------------------------------------------------------------- category groups


@query("category_groups", "category_group:s size:l category:s",
       """select string_agg(c, '_' order by c) as category_group, count(*) as size, unnest(list(c)) as category from (
            select k, category as c, seen from (select category, bit_or(case when Pos = 1 then 2 else 1 end) as seen,
                row_number() over (order by category) - 1 as i, count(*) over () as n from preds group by category),
              range(1, 2048) t(k) where k < (1 << n) - 1 and (k >> i) & 1 = 1)
          group by k having bit_or(seen) = 3""", "preds")
def _(spark, sf):
    """Evaluable combinations of categories of every size."""
    return G.category_groups(fx.preds(spark, sf), BINARY)


@query("category_pairs_of_many", "category_group:s size:l category:s",
       """with c as (select n_name as category, list(distinct c_mktsegment) as seen from customer join nation on c_nationkey = n_nationkey
                      group by n_name),
            p as (select a.category || '_' || b.category as g, [a.category, b.category] as m from c a join c b on a.category < b.category
                  where len(list_distinct(list_concat(a.seen, b.seen))) = 5)
          select g as category_group, 2 as size, unnest(m) as category from p""")
def _(spark, sf):
    """Pairs out of 25 categories in which all five classes occur."""
    rows = fx.table(spark, sf, "customer").join(fx.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    classes = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    rows = rows.select(F.col("n_name").alias("category"), *[(F.col("c_mktsegment") == c).cast("int").alias(c) for c in classes])
    return G.category_groups(rows, CohortSpec(TrainType.CLF, classes), sizes=(2,))


@query("binary_report_category_groups", "split:s level:s category_group:s n:l n_pos:l auc:d",
       """select split, level, category_group, count(*) as n, max(p) as n_pos,
            (sum(case when y = 1 then r end) - max(p) * (max(p) + 1) / 2.0e0)
              / nullif(max(p) * cast(count(*) - max(p) as double), 0) as auc
          from (select *, rank() over (partition by split, level, category_group order by s)
                  + (count(*) over (partition by split, level, category_group, s) - 1) / 2.0e0 as r,
                  sum(y) over (partition by split, level, category_group) as p from (
                select split, level, category_group, s, y from members)) group by split, level, category_group""",
       "preds",
       present="""select category, bit_or(case when Pos = 1 then 2 else 1 end) as seen, row_number() over (order by category) - 1 as i,
              count(*) over () as c from preds group by category""",
       combos="""select k, string_agg(category, '_' order by category) as category_group, count(*) as size from present, range(1, 2048) t(k)
              where k < (1 << c) - 1 and (k >> i) & 1 = 1 group by k having bit_or(seen) = 3""",
       kept="select * from combos",
       members="""select split, 'all' as level, 'all' as category_group, out1 as s, Pos as y from preds
          union all select split, 'category', category_group, out1, Pos from preds join present using (category) join kept on (k >> i) & 1 = 1
          union all select split, 'category2', category2, out1, Pos from preds
            join (select category2 from preds group by category2 having max(Pos) = 1 and min(Pos) = 0) using (category2)""")
def _(spark, sf):
    """Whole table and all category groups of two levels, per split, in one plan."""
    return M.evaluate_binary(fx.preds(spark, sf), BINARY, {"": None, "2": (1,)})


@query("multiclass_category_groups", "split:s level:s category_group:s n:l acc:d kappa:d auc:d",
       """select split, level, category_group, n, acc, kappa, auc from (select split, level, category_group, count(*) as n, avg(cast(y = p as integer)) as acc,
              (avg(cast(y = p as integer)) - {pe}) / (1 - {pe}) as kappa from mem group by split, level, category_group)
          join (select split, level, category_group, avg(auc) as auc from (
              select split, level, category_group, class, (sum(case when t = 1 then r end) - max(pos) * (max(pos) + 1) / 2.0e0)
                / nullif(max(pos) * cast(count(*) - max(pos) as double), 0) as auc from (
                select *, rank() over (partition by split, level, category_group, class order by s)
                    + (count(*) over (partition by split, level, category_group, class, s) - 1) / 2.0e0 as r,
                  sum(t) over (partition by split, level, category_group, class) as pos from (
                  select split, level, category_group, k as class, cast(y = k as integer) as t, case k when 0 then out0 when 1 then out1 else out2 end as s
                  from mem, range(0, 3) c(k))) group by split, level, category_group, class) group by split, level, category_group)
          using (split, level, category_group)""".format(pe="(" + " + ".join(
              f"cast(count(*) filter (y = {k}) as double) * count(*) filter (p = {k})" for k in range(3)) + ") / (cast(count(*) as double) * count(*))"),
       "preds3", cat=f"select *, 'k' || cast(length(name) % 3 as varchar) as category, {ARGMAX3} as p from preds3",
       present="""select category, bit_or(1 << y) as seen, row_number() over (order by category) - 1 as i, count(*) over () as c from cat group by category""",
       combos="""select k, string_agg(category, '_' order by category) as category_group, count(*) as size from present, range(1, 2048) t(k)
              where k < (1 << c) - 1 and (k >> i) & 1 = 1 group by k having bit_or(seen) = 7""",
       kept="select * from combos",
       mem="""select 'all' as level, 'all' as category_group, cat.* from cat union all
              select 'category', category_group, cat.* from cat join present using (category) join kept on (k >> i) & 1 = 1""")
def _(spark, sf):
    """Matrix metrics and macro AUC for all category groups."""
    df = fx.preds3(spark, sf).withColumn("category", F.concat(F.lit("k"), (F.length("name") % 3).cast("string")))
    return M.evaluate_multiclass(df, THREE, {"": None})


@query("metrics_long_form", "split:s metric:s value:d",
       "select split, 'auc' as metric, auc as value from aucs union all select split, 'n', sum(pos + neg) from counts group by split "
       "union all select split, 'n_pos', sum(pos) from counts group by split", "preds",
       **binary_steps("split", COUNTS.format(g="split")))
def _(spark, sf):
    """A report turned into (split, metric, value)."""
    return M.to_long_metrics(B.roc_auc(fx.preds(spark, sf), "Pos", "out1", ["split"]), ["split"])


@query("user_evaluator_per_split", "split:s n:l spread:d",
       "select split, count(*) as n, max(out1) - min(out1) as spread from preds group by split", "preds")
def _(spark, sf):
    """A user's pandas evaluator on every split, from mergeable parts."""
    def spread(pdf):
        return pdf.groupby("split", as_index=False).agg(n=("out1", "size"), hi=("out1", "max"), lo=("out1", "min"))

    return M.user_evaluation(fx.preds(spark, sf).select("split", "out1"), ["split"], spread, "split string, n long, hi double, lo double",
                             {"n": F.sum("n"), "hi": F.max("hi"), "lo": F.min("lo")}, {"n": F.col("n"), "spread": F.col("hi") - F.col("lo")})


GROUPED = """select split, 'all' as level, 'all' as category_group, {cols} from {table}
          union all select split, 'category', category, {cols} from {table}
          union all select split, 'category2', category2, {cols} from {table}"""


@query("regression_category_groups", "split:s level:s category_group:s n:l mse:d rmse:d r2:d",
       """select split, level, category_group, count(*) as n, avg(power(y - out1, 2)) as mse, sqrt(avg(power(y - out1, 2))) as rmse,
            case when var_pop(y) > 0 then 1 - avg(power(y - out1, 2)) / var_pop(y) else 0 end as r2
          from rows group by split, level, category_group""", "preds", digits=5,
       base="select preds.*, n_chars / 1000.0e0 as y from preds join (select name, n_chars from cohort) using (name)",
       rows=GROUPED.format(cols="y, out1", table="base"))
def _(spark, sf):
    """Regression metrics of the whole table and of every category of two levels."""
    c = fx.cohort(spark, sf).select("name", (F.col("n_chars") / 1000.0).alias("y"))
    spec = CohortSpec(TrainType.REGR, ("y",))
    return M.evaluate_groups(fx.preds(spark, sf).join(c, "name"), spec, M.regression_evaluator("y", "out1"))


@query("multilabel_category_groups", "split:s level:s category_group:s n:l acc:d f1_micro:d f1_macro:d",
       """select split, level, category_group, count(*) as n, avg(cast(p0 = Neg and p1 = Pos as integer)) as acc,
            coalesce(2.0e0 * sum(p0 * Neg + p1 * Pos) / nullif(sum(p0 + Neg + p1 + Pos), 0), 0) as f1_micro,
            (coalesce(2.0e0 * sum(p0 * Neg) / nullif(sum(p0 + Neg), 0), 0) + coalesce(2.0e0 * sum(p1 * Pos) / nullif(sum(p1 + Pos), 0), 0)) / 2 as f1_macro
          from rows group by split, level, category_group""", "preds",
       base="select *, cast(out0 >= 0.5 as integer) as p0, cast(out1 >= 0.4 as integer) as p1 from preds",
       complete="select category from base group by category having max(Neg) = 1 and max(Pos) = 1",
       complete2="select category2 from base group by category2 having max(Neg) = 1 and max(Pos) = 1",
       rows="""select split, 'all' as level, 'all' as category_group, Neg, Pos, p0, p1 from base
          union all select split, 'category', category, Neg, Pos, p0, p1 from base join complete using (category)
          union all select split, 'category2', category2, Neg, Pos, p0, p1 from base join complete2 using (category2)""")
def _(spark, sf):
    """Multilabel metrics of the whole table and of every category in which both labels occur."""
    df = fx.preds(spark, sf).withColumns({"pred0": (F.col("out0") >= 0.5).cast("int"), "pred1": (F.col("out1") >= 0.4).cast("int")})
    return M.evaluate_multilabel(df, CohortSpec(TrainType.MULTILABEL, ("Neg", "Pos")))


# ---------------------------------------------------------------- predictions and ensembles

@query("predictions_added", "name:s pred0:l pred1:l pred_wrong:l pred_diff:d",
       """select name, cast(out0 >= out1 as integer) as pred0, cast(out1 > out0 as integer) as pred1,
            cast((out1 > out0) <> (Pos = 1) as integer) as pred_wrong, (abs(Neg - out0) + abs(Pos - out1)) / 2 as pred_diff from preds""", "preds")
def _(spark, sf):
    """One-hot predictions, wrong flag and mean absolute difference."""
    return P.add_predictions(fx.preds(spark, sf), BINARY)


@query("predictions_added_multilabel", "name:s pred0:l pred1:l pred2:l pred_wrong:l",
       """select name, cast(out0 >= 0.5 as integer) as pred0, cast(out1 >= 0.5 as integer) as pred1, cast(out2 >= 0.5 as integer) as pred2,
            cast((out0 >= 0.5) <> (other = 1) or (out1 >= 0.5) <> (quality = 1) or (out2 >= 0.5) <> (toxic = 1) as integer) as pred_wrong
          from preds_ml""", "preds_ml")
def _(spark, sf):
    return P.add_predictions(fx.preds_ml(spark, sf), MULTI)


@query("scores_from_logits", "name:s out0:d out1:d out2:d", "select name, out0, out1, out2 from preds3", "preds3")
def _(spark, sf):
    """Softmax scores from logits."""
    df = fx.preds3(spark, sf).drop("out0", "out1", "out2")
    return P.add_scores(df, THREE, ["logit0", "logit1", "logit2"])


@query("ensemble_of_predictions", "name:s split:s Pos:l out0:d out0_std:d out1:d out1_std:d",
       """select name, max(split) as split, max(Pos) as Pos, avg(out0) as out0, stddev_samp(out0) as out0_std,
            avg(out1) as out1, stddev_samp(out1) as out1_std from ensemble group by name""", "ensemble")
def _(spark, sf):
    """Five prediction tables to one: mean and sample deviation of scores, other columns unique."""
    return P.ensemble_predictions(fx.ensemble(spark, sf), n_members=5)


@query("records_aggregated", "category:s out1:d out1_std:d split:s",
       """select category, avg(out1) as out1, stddev_pop(out1) as out1_std, string_agg(split, ';' order by split) as split
          from preds group by category""", "preds")
def _(spark, sf):
    """Records of a group merged by column type."""
    return P.aggregate_records(fx.preds(spark, sf).select("category", "split", "out1"), ["category"])


@query("array_records_aggregated", "cls:l pos:l mean:d std:d",
       """select cls, pos - 1 as pos, avg(v) as mean, stddev_pop(v) as std from (
            select label % 3 as cls, unnest(range(1, 65)) as pos, cast(unnest(embedding) as double) as v from embeddings) group by cls, pos""")
def _(spark, sf):
    """Elementwise mean and population deviation of arrays per class."""
    e = fx.table(spark, sf, "embeddings").select((F.col("label") % 3).alias("cls"),
                                                 F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    out = P.aggregate_records(e, ["cls"])
    return out.select("cls", F.posexplode(F.arrays_zip("v", "v_std")).alias("pos", "z")).select(
        "cls", "pos", F.col("z.v").alias("mean"), F.col("z.v_std").alias("std"))


@query("key_wise_sums", "split:s key:s value:d",
       """select split, 'n' as key, count(*) as value from preds group by split union all
          select split, 'score', sum(out1) from preds group by split""", "preds")
def _(spark, sf):
    """Key-wise sums of map columns."""
    df = fx.preds(spark, sf).withColumn("m", F.create_map(F.lit("n"), F.lit(1.0), F.lit("score"), F.col("out1")))
    return P.sum_maps(df, "m", ["split"])


@query("targets_from_text", "name:s target0:l target1:l target2:l single:l",
       """select name, other as target0, quality as target1, toxic as target2,
            case when other + quality + toxic = 1 then case when toxic = 1 then 2 when quality = 1 then 1 else 0 end end as single
          from cohort_ml""", "cohort_ml")
def _(spark, sf):
    """Older prediction tables: list text to one-hot targets, single targets to a number."""
    df = fx.cohort_ml(spark, sf)
    text = F.concat(F.lit("["), F.array_join(L.label_indices(MULTI.target_cols), ", "), F.lit("]"))
    df = df.select("name", text.alias("target"))
    return P.targets_from_text(df, "target", 3).withColumn("single", P.single_target("target"))


@query("mean_risk", "name:s risk:d", "select name, (out0 + out1 + out2) / 3 as risk from preds3", "preds3")
def _(spark, sf):
    return fx.preds3(spark, sf).withColumn("risk", L.row_mean(THREE.out_cols))


@query("score_column_means", "var:s mean:d",
       """select 'out0' as var, avg(out0) as mean from preds union all select 'out1', avg(out1) from preds
          union all select 'pred0', avg(cast(out0 >= out1 as integer)) from preds
          union all select 'pred1', avg(cast(out1 > out0 as integer)) from preds""", "preds")
def _(spark, sf):
    """Means of the score and prediction columns found by prefix (pred_ columns are not predictions)."""
    df = P.add_predictions(fx.preds(spark, sf), BINARY)
    return PR.column_stats(df, C.out_columns(df, BINARY) + C.pred_columns(df, BINARY))
