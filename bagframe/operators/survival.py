"""Survival analysis: Kaplan-Meier, Nelson-Aalen, log-rank, concordance, cut-offs, Cox loss.

Rows are first reduced to one row per (group, time), so ties of any size are harmless; running sums use the block
scan of :mod:`bagframe.operators.scan`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagframe.functions.stats import chi2_pvalue, ratio
from bagframe.operators.scan import BLOCK, exact_quantiles, ordered_scan, with_blocks


def event_table(df: DataFrame, duration: str, event: str, group: Sequence[str] = (), blocks: int | None = None,
                keep_block: bool = False) -> DataFrame:
    """(group..., time, events, censored, at_risk, total)."""
    t = df.groupBy(*group, F.col(duration).cast("double").alias("time")).agg(
        F.count_if(F.col(event) == 1).alias("events"), F.count_if(F.col(event) != 1).alias("censored"))
    t = t.withColumn("__n", F.col("events") + F.col("censored"))
    s = ordered_scan(t, "time", group, ["__n"], descending=True, blocks=blocks, keep_block=keep_block)
    return s.select(*group, "time", "events", "censored", F.col("cum___n").alias("at_risk"),
                    F.col("total___n").alias("total"), *([BLOCK] if keep_block else []))


def survival_curves(df: DataFrame, duration: str, event: str, group: Sequence[str] = (), origin: bool = True,
                    blocks: int | None = None) -> DataFrame:
    """(group..., time, at_risk, events, censored, survival, cumulative_hazard) per distinct time.

    ``survival`` is the Kaplan-Meier product, ``cumulative_hazard`` the Nelson-Aalen sum. ``origin`` adds the row at
    time 0 when no row has that time.
    """
    t = event_table(df, duration, event, group, blocks, keep_block=True)
    d, n = F.col("events"), F.col("at_risk")
    t = t.withColumns({
        "__log": F.when(d < n, F.log(1 - ratio(d, n))).otherwise(F.lit(0.0)),
        "__dead": F.when(d == n, 1).otherwise(0), "__haz": ratio(d, n)})
    s = ordered_scan(t, "time", group, ["__log", "__dead", "__haz"], block_expr=F.col(BLOCK))
    first = F.col("at_risk") == F.col("total")
    row = F.struct("time", "at_risk", "events", "censored",
                   F.when(F.col("cum___dead") > 0, F.lit(0.0)).otherwise(F.exp("cum___log")).alias("survival"),
                   F.col("cum___haz").alias("cumulative_hazard"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0.0).alias("time"), F.col("total").alias("at_risk"), zero.alias("events"),
                     zero.alias("censored"), F.lit(1.0).alias("survival"), F.lit(0.0).alias("cumulative_hazard"))
    add = first & (F.col("time") > 0) if origin else F.lit(False)
    rows = F.when(add, F.array(start, row)).otherwise(F.array(row))
    return s.select(*group, F.explode(rows).alias("r")).select(*group, "r.*")


def events_label(event: str) -> Column:
    """Aggregate: `` (d/n events)``."""
    return F.format_string(" (%d/%d events)", F.count_if(F.col(event) == 1), F.count(F.lit(1)))


def logrank(df: DataFrame, duration: str, event: str, arm: str, group: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Pairwise log-rank tests between the values of ``arm``: (group..., a, b, statistic, p).

    Arms are a small set; every (arm, time) row takes part in one pair per other arm.
    """
    x = df.groupBy(*group, F.col(arm).alias("__arm"), F.col(duration).cast("double").alias("time")).agg(
        F.count_if(F.col(event) == 1).alias("__d"), F.count(F.lit(1)).alias("__n"))
    arms = df.groupBy(*group).agg(F.array_sort(F.collect_set(arm)).alias("__arms"))
    x = x.join(arms, list(group)) if group else x.withColumn("__arms", arms.scalar())
    x = x.withColumn("__o", F.explode(F.filter("__arms", lambda a: a != F.col("__arm"))))
    left = F.col("__arm") < F.col("__o")
    x = x.select(*group, F.least("__arm", "__o").alias("a"), F.greatest("__arm", "__o").alias("b"), "time",
                 F.when(left, F.col("__d")).otherwise(0).alias("d1"), F.when(left, F.col("__n")).otherwise(0).alias("n1"),
                 F.when(left, 0).otherwise(F.col("__d")).alias("d2"), F.when(left, 0).otherwise(F.col("__n")).alias("n2"))
    pair = [*group, "a", "b"]
    x = x.groupBy(*pair, "time").agg(*[F.sum(c).alias(c) for c in ("d1", "n1", "d2", "n2")])
    s = ordered_scan(x, "time", pair, ["n1", "n2"], descending=True, blocks=blocks)
    d, r1, r2 = F.col("d1") + F.col("d2"), F.col("cum_n1").cast("double"), F.col("cum_n2").cast("double")
    r = r1 + r2
    expected = d * r1 / r
    variance = F.when(r > 1, d * (r1 / r) * (r2 / r) * ratio(r - d, r - 1)).otherwise(0.0)
    out = s.groupBy(*pair).agg(F.sum(F.col("d1") - expected).alias("__u"), F.sum(variance).alias("__v"))
    out = out.select(*pair, ratio(F.col("__u") * F.col("__u"), F.col("__v")).alias("statistic"))
    return out.withColumn("p", chi2_pvalue(F.col("statistic"), F.lit(1)))


def _score_nodes(df: DataFrame, duration: str, event: str, score: str, group: list[str], part: list[str], blocks: int | None) -> DataFrame:
    """(group..., part..., level, node, time, block, ie, je, jc): distinct (time, score) rows in their nodes. Two scores a < b of a group share one
    node of a level >= 0, in which a's events are ie and b's rows je (events) and jc (censored); equal scores share one of level -1, and
    level -2 holds all."""
    base = df.groupBy(*group, *part, F.col(duration).cast("double").alias("time"), F.col(score).cast("double").alias("__s")).agg(
        F.count_if(F.col(event) == 1).alias("__e"), F.count_if(F.col(event) != 1).alias("__c"))
    ranks = df.select(*group, F.col(score).cast("double").alias("__s")).distinct().withColumn("__one", F.lit(1).cast("long"))
    ranks = ordered_scan(ranks, "__s", group, ["__one"], blocks=blocks).select(
        *group, "__s", (F.col("cum___one") - 1).alias("__rank"), F.col("total___one").alias("__distinct"))
    x = with_blocks(base, "time", blocks, [*group, *part, "__s", "__e", "__c"]).withColumnRenamed(BLOCK, "__tb")
    x = x.join(ranks, [*group, "__s"])
    bits = F.when(F.col("__distinct") > 1, F.length(F.bin(F.col("__distinct") - 1))).otherwise(0)
    zero = F.lit(0).cast("long")

    def node(level: Column, number: Column, i: Column, je: Column, jc: Column) -> Column:
        return F.struct(level.cast("int").alias("level"), number.cast("long").alias("node"), i.alias("ie"),
                        je.alias("je"), jc.alias("jc"))

    levels = F.when(bits > 0, F.sequence(F.lit(0), bits - 1)).otherwise(F.array().cast("array<int>"))
    rank, e, c = F.col("__rank"), F.col("__e"), F.col("__c")

    def bit_node(lev: Column) -> Column:
        one = F.call_function("shiftright", rank, lev) % 2 == 1
        return node(lev, F.call_function("shiftright", rank, lev + 1), F.when(one, zero).otherwise(e),
                    F.when(one, e).otherwise(zero), F.when(one, c).otherwise(zero))

    nodes = F.concat(F.array(node(F.lit(-2), zero, e, e, c), node(F.lit(-1), rank, e, e, c)),
                     F.transform(levels, bit_node))
    return x.select(*group, *part, "time", "__tb", F.explode(nodes).alias("k")).groupBy(
        *group, *part, "k.level", "k.node", "time", "__tb").agg(*[F.sum(f"k.{v}").alias(v) for v in ("ie", "je", "jc")])


def _pair_sums(pairs: Column) -> list[Column]:
    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, pairs)), F.lit(0).cast("long"))

    return [total(F.col("level") == -2).alias("comparable"), total(F.col("level") >= 0).alias("concordant"), total(F.col("level") == -1).alias("tied")]


def harrell(comparable: str = "comparable", concordant: str = "concordant", tied: str = "tied") -> Column:
    return ratio(F.col(concordant) + F.col(tied) / 2.0, F.col(comparable))


def concordance(df: DataFrame, duration: str, event: str, score: str, group: Sequence[str] = (),
                blocks: int | None = None) -> DataFrame:
    """(group..., comparable, concordant, tied, cind): Harrell's index, a higher score means living longer.

    A pair (i, j) is comparable when i has an event and T_i < T_j, or T_i = T_j and j is censored. It is concordant
    when s_i < s_j and counts one half when the scores are equal. NULL when no pair is comparable.

    No pairs are formed. For score ranks a < b there is exactly one bit position where they share all higher bits, a
    has 0 and b has 1. So each distinct (time, score) row is put into one node per bit (about log2 of the number of
    distinct scores), and inside a node concordant pairs are a running count of events along time.
    """
    group = list(group)
    x = _score_nodes(df, duration, event, score, group, [], blocks)
    s = ordered_scan(x, "time", [*group, "level", "node"], ["ie"], block_expr=F.col("__tb"))
    pairs = F.col("je") * (F.col("cum_ie") - F.col("ie")) + F.col("jc") * F.col("cum_ie")
    return s.groupBy(*group).agg(*_pair_sums(pairs)).withColumn("cind", harrell())


def concordance_between(df: DataFrame, duration: str, event: str, score: str, part: str, wanted: DataFrame, group: Sequence[str] = (),
                        blocks: int | None = None) -> DataFrame:
    """(group..., a, b, comparable, concordant, tied): the pair counts of :func:`concordance` with i from the part a and j from the part b, for the
    ``wanted`` (a, b). Sums of these cells are the counts of any union of parts. In a node, events of part a run along time, and the rows of
    the parts b that ask for a read the running count; a row meets each a that is wanted with its part, and no other row."""
    group = list(group)
    x = _score_nodes(df.where(F.col(part).isNotNull()), duration, event, score, group, [part], blocks)
    here = [*group, "level", "node", "time", "__tb"]
    none = F.lit(None).cast("struct<b:string,je:bigint,jc:bigint>")
    left = x.where("ie > 0").select(*here, F.col(part).cast("string").alias("a"), "ie", none.alias("j"))
    asking = x.where("je + jc > 0").select(*here, F.struct(F.col(part).cast("string").alias("b"), "je", "jc").alias("j"), F.col(part).cast("string").alias("b"))
    right = asking.join(wanted.select(F.col("a").cast("string"), F.col("b").cast("string")).distinct(), "b").select(*here, "a", F.lit(0).cast("long").alias("ie"), "j")
    rows = left.unionByName(right).groupBy(*here, "a").agg(F.sum("ie").alias("ie"), F.collect_list("j").alias("js"))      # a part at the most once in js
    s = ordered_scan(rows, "time", [*group, "level", "node", "a"], ["ie"], block_expr=F.col("__tb"))
    s = s.select(*group, "a", "level", "ie", "cum_ie", F.explode("js").alias("j"))
    pairs = F.col("j.je") * (F.col("cum_ie") - F.col("ie")) + F.col("j.jc") * F.col("cum_ie")
    return s.groupBy(*group, "a", F.col("j.b").alias("b")).agg(*_pair_sums(pairs))


def dichotomise(df: DataFrame, marker: str, out: str = "arm", cutoff: str | float | Column = "median",
                group: Sequence[str] = ()) -> DataFrame:
    """Add 0/1 ``out`` and ``cutoff``: marker >= cutoff when the smallest value is below it, else marker > cutoff.

    ``cutoff`` is median, mean, a number, or an aggregate expression over the marker.
    """
    low = df.groupBy(*group).agg(F.min(F.col(marker).cast("double")).alias("__min"), F.avg(marker).alias("__mean"),
                                 *([cutoff.alias("__cut")] if isinstance(cutoff, Column) else []))
    if isinstance(cutoff, Column):
        cut = F.col("__cut").cast("double")
    elif cutoff == "median":
        med = exact_quantiles(df, marker, [0.5], group).select(*group, F.col("quantiles")[0].alias("__med"))
        low = low.join(med, list(group)) if group else low.withColumn("__med", med.scalar())
        cut = F.col("__med")
    else:
        cut = F.col("__mean") if cutoff == "mean" else F.lit(float(cutoff))
    low = low.select(*group, F.struct(F.col("__min").alias("lo"), cut.alias("cut")).alias("__l"))
    x = df.join(low, list(group)) if group else df.withColumn("__l", low.scalar())
    m, c = F.col(marker), F.col("__l.cut")
    arm = F.when(F.col("__l.lo") < c, m >= c).otherwise(m > c).cast("int")
    return x.withColumn(out, arm).withColumn("cutoff", c).drop("__l")


def survival_report(df: DataFrame, duration: str, event: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """(group..., n, n_events, cind, p): concordance, and the log-rank p of a median split of the score.

    With only one event class p is -1; with one arm only p is NULL.
    """
    group = list(group)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(event) == 1).alias("n_events"))
    cind = concordance(df, duration, event, score, group).select(*group, "cind")
    lr = logrank(dichotomise(df, score, "__arm_", "median", group), duration, event, "__arm_", group).select(*group, "p")
    if group:
        out = sizes.join(cind, group).join(lr, group, "left")
    else:
        p = lr.agg(F.max("p").alias("p"))
        out = sizes.withColumn("cind", cind.scalar()).withColumn("p", p.scalar())
    both = (F.col("n_events") > 0) & (F.col("n_events") < F.col("n"))
    return out.withColumn("p", F.when(both, F.col("p")).otherwise(F.lit(-1.0)))


def cox_loss(df: DataFrame, duration: str, event: str, score: str, group: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """(group..., loss): negative Cox partial log-likelihood per event of given scores.

    The risk set of a row is every row with at least its duration, so the result does not depend on the order of
    equal durations. Exponentials are shifted by the largest score of the group.
    """
    group = list(group)
    s = F.col(score).cast("double")
    top = df.groupBy(*group).agg(F.max(s).alias("__top"))
    x = df.join(top, group) if group else df.withColumn("__top", top.scalar())
    t = x.groupBy(*group, F.col(duration).cast("double").alias("time")).agg(
        F.sum(F.exp(s - F.col("__top"))).alias("__r"), F.count_if(F.col(event) == 1).alias("__d"),
        F.sum(F.when(F.col(event) == 1, s).otherwise(0.0)).alias("__se"), F.max("__top").alias("__top"))
    c = ordered_scan(t, "time", group, ["__r"], descending=True, blocks=blocks)
    lse = F.log(F.col("cum___r") + 1e-7) + F.col("__top")
    return c.groupBy(*group).agg(
        ratio(F.sum(F.col("__d") * lse) - F.sum("__se"), F.sum("__d")).alias("loss"))
