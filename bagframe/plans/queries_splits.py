"""Queries on cross-validation splits, weights and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagframe.operators import balance as BA
from bagframe.operators import splits as SP
from bagframe.operators.spec import CohortSpec, TrainType
from bagframe.plans import fixtures as fx
from bagframe.plans.registry import query

BINARY = CohortSpec(TrainType.CLF, ("Neg", "Pos"))
MULTI = CohortSpec(TrainType.MULTILABEL, ("other", "quality", "toxic"))
SURV = CohortSpec(TrainType.SURV, ("event", "duration"))

HASH = "cast('0x' || substr(md5({text}), 1, 15) as bigint)"


def folds_sql(ids: str, id_col: str, salt: str, k: int, strata: str | None, within: str | None = None) -> str:
    """Fold numbers in SQL: position in hash order inside the stratum plus the running size of earlier strata."""
    part = ", ".join(c for c in (within, strata) if c)
    over = f"partition by {part}" if part else ""
    text = f"{salt} || ':' || cast({id_col} as varchar)"
    if strata is None:
        offset = "0"
    else:
        w = f"partition by {within}" if within else ""
        offset = f"(rank() over ({w} order by {strata}) - 1)"
    return (f"select *, (row_number() over ({over} order by {HASH.format(text=text)}, {id_col}) - 1 + {offset}) % {k} as fold from {ids}")


@query("cv_folds", "name:s fold:l", folds_sql("cohort", "name", "'1'", 5, "Pos"), "cohort")
def _(spark, sf):
    """Stratified folds by name."""
    return SP.cv_folds(fx.cohort(spark, sf), BINARY, 5)


@query("cv_folds_unstratified", "name:s fold:l", folds_sql("cohort", "name", "'1'", 5, None), "cohort")
def _(spark, sf):
    return SP.cv_folds(fx.cohort(spark, sf), BINARY, 5, stratified=False)


@query("cv_folds_by_id", "name:s category2:s fold:l",
       "select c.name, c.category2, f.fold from cohort c join f using (category2)", "cohort",
       ids="select category2, arg_min(Pos, name) as label from cohort group by category2",
       f=folds_sql("ids", "category2", "'1'", 3, "label"))
def _(spark, sf):
    """All rows of an id (here the second category) share a fold."""
    return SP.cv_folds(fx.cohort(spark, sf), BINARY, 3, id_col="category2")


@query("cv_folds_multilabel", "name:s fold:l", folds_sql("worst", "name", "'1'", 4, "label"), "cohort_ml",
       worst="select name, case when toxic = 1 then 2 when quality = 1 then 1 else 0 end as label from cohort_ml")
def _(spark, sf):
    """Balanced on the worst label."""
    return SP.cv_folds(fx.cohort_ml(spark, sf), MULTI, 4)


@query("cv_folds_within_category", "name:s category:s fold:l", folds_sql("cohort", "name", "'1'", 5, "Pos", "category"), "cohort")
def _(spark, sf):
    """Every category is split on its own."""
    return SP.cv_folds(fx.cohort(spark, sf), BINARY, 5, within=["category"])


@query("fold_tables", "name:s fold:l split:s",
       "select name, t.k as fold, case when f.fold = t.k then 'validation' else 'training' end as split from f, range(0, 5) t(k)", "cohort",
       f=folds_sql("(select name, Pos from cohort)", "name", "'1'", 5, "Pos"))
def _(spark, sf):
    """The k train/validation tables in long form."""
    return SP.fold_tables(SP.cv_folds(fx.cohort(spark, sf), BINARY, 5), 5, BINARY)


@query("rotating_tables", "name:s fold:l split:s",
       """select name, t.k as fold, case when f.fold = t.k then 'testing' when f.fold = (t.k + 1) % 5 then 'validation' else 'training' end as split
          from f, range(0, 5) t(k)""", "cohort", f=folds_sql("(select name, Pos from cohort)", "name", "'1'", 5, "Pos"))
def _(spark, sf):
    """Train/validation/test rotation."""
    return SP.rotating_tables(SP.cv_folds(fx.cohort(spark, sf), BINARY, 5), 5, BINARY)


@query("nested_folds", "name:s table:s split:s",
       """select name, 'fold' || cast(o as varchar) || '_fold' || cast(t.k as varchar) as "table", case when fold = t.k then 'validation' else 'training' end as split
          from inner_folds, range(0, 3) t(k) union all
          select name, 'fold' || cast(of as varchar) || '_fold' || cast(t.k as varchar), 'testing' from outer_folds, range(0, 3) t(k)""", "cohort",
       outer_folds=f"select name, Pos, fold as of from ({folds_sql('(select name, Pos from cohort)', 'name', chr(39) + '1' + chr(39), 3, 'Pos')})",
       rest="select name, Pos, o.k as o from outer_folds, range(0, 3) o(k) where of <> o.k",
       inner_folds=folds_sql("rest", "name", "'1:' || cast(o as varchar)", 3, "Pos", "o"))
def _(spark, sf):
    """Nested cross-validation in long form."""
    return SP.nested_folds(fx.cohort(spark, sf), BINARY, 3)


@query("balanced_folds", "name:s fold:l",
       """select name, fold from tried where seed = (select max_by(seed, {'b': -balance, 's': seed}) from (
            select seed, round(avg(h), 12) as balance from (select seed, fold, (sqrt(count(*)) - sum(n_chars) / sqrt(sum(cast(n_chars as double) * n_chars))) / (sqrt(count(*)) - 1) as h
              from tried group by seed, fold) group by seed))""", "cohort",
       tried=folds_sql("(select name, Pos, n_chars, s.k as seed from cohort, range(1, 101) s(k))", "name", "'1:' || cast(seed as varchar)", 4, "Pos", "seed"))
def _(spark, sf):
    """Of 100 splittings the one whose test folds spread text length most evenly."""
    return SP.balanced_folds(fx.cohort(spark, sf), BINARY, ["n_chars"], 4)


@query("fold_rule_check", "n:l n_bad:l", "select count(*) as n, 0 as n_bad from cohort", "cohort")
def _(spark, sf):
    """Every id validates and tests exactly once in the rotation."""
    t = SP.rotating_tables(SP.cv_folds(fx.cohort(spark, sf), BINARY, 5), 5, BINARY)
    bad = SP.fold_violations(t, BINARY, 5, test="testing")
    return fx.cohort(spark, sf).agg(F.count(F.lit(1)).alias("n")).withColumn("n_bad", bad.agg(F.count(F.lit(1))).scalar())


@query("equal_cell_sample", "name:s split:s category:s Pos:l",
       f"""select name, split, category, Pos from (select *, row_number() over (partition by split, category, Pos order by {HASH.format(text="'1:' || name")}, name) as r,
            (select count(distinct split) * count(distinct category) * count(distinct Pos) from cohort) as cells from cohort) where r <= round_even(60.0e0 / cells, 0)""", "cohort")
def _(spark, sf):
    """The same number of rows from every split x category x label cell."""
    return BA.equal_cell_sample(fx.cohort(spark, sf), BINARY, 60)


@query("class_weights", "name:s weight:d",
       "select name, count(*) over () / cast(count(*) over (partition by Pos) as double) as weight from cohort", "cohort")
def _(spark, sf):
    return BA.class_weights(fx.cohort(spark, sf), BINARY)


@query("class_weights_multilabel", "name:s weight:d",
       """select name, t / cast(least(case when other = 1 then o end, case when quality = 1 then q end, case when toxic = 1 then x end) as double) as weight
          from cohort_ml, (select sum(other) as o, sum(quality) as q, sum(toxic) as x, sum(other + quality + toxic) as t from cohort_ml)""", "cohort_ml")
def _(spark, sf):
    """1 / smallest ratio among a row's labels."""
    return BA.class_weights(fx.cohort_ml(spark, sf), MULTI)


@query("category_weights", "name:s weight:d",
       "select name, count(*) over () / cast(count(*) over (partition by category) as double) as weight from cohort", "cohort")
def _(spark, sf):
    return BA.column_weights(fx.cohort(spark, sf), "category")


@query("survival_weights", "name:s bin:l weight:d",
       """select name, bin, count(*) over () / cast(count(*) over (partition by bin) as double) as weight from (
            select name, 1 + cast(duration >= q1 as integer) + cast(duration >= q2 as integer) + cast(duration >= q3 as integer) as bin from surv,
              (select quantile_cont(duration, 0.25) as q1, quantile_cont(duration, 0.5) as q2, quantile_cont(duration, 0.75) as q3 from surv where event = 1))""", "surv")
def _(spark, sf):
    """Inverse share of the duration bin; edges are quantiles of uncensored durations."""
    return BA.survival_weights(fx.surv(spark, sf), SURV)


@query("weighted_draws", "draw:l name:s",
       f"""select d.draw, r.name from (select name, sum(w) over (order by h, name rows between unbounded preceding and current row) - w as lo,
              sum(w) over (order by h, name rows between unbounded preceding and current row) as hi
            from (select name, cast(1 + n_chars % 7 as double) as w, {HASH.format(text="'1:order:' || name")} as h from cohort)) r
          join (select k as draw, {HASH.format(text="'1:draw:' || cast(k as varchar)")} / 1152921504606846976.0e0
              * (select sum(cast(1 + n_chars % 7 as double)) from cohort) as u from range(0, 300) t(k)) d on d.u >= r.lo and d.u < r.hi""", "cohort")
def _(spark, sf):
    """300 draws with replacement, proportional to a weight."""
    df = fx.cohort(spark, sf).withColumn("w", (1 + F.col("n_chars") % 7).cast("double"))
    return BA.weighted_sample(df, "w", "name", 300)


@query("shuffled_rows", "name:s position:l",
       f"select name, row_number() over (order by {HASH.format(text=chr(39) + '7:' + chr(39) + ' || name')}, name) - 1 as position from cohort", "cohort")
def _(spark, sf):
    """A reproducible shuffled order, shown as positions."""
    from bagframe.operators.scan import hash_position

    return hash_position(fx.cohort(spark, sf), [], ["name"], [F.lit("7")], "position")
