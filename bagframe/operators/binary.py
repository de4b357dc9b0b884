"""Binary evaluation: confusion counts, ROC, AUC, thresholds, chi-square, calibration, permutation tests.

Everything starts from :func:`score_counts`, one row per (group, distinct score) with the number of positives and
negatives. That table is built with map-side partial sums, so raw rows are shuffled at most once and a score shared
by a third of all rows is one row afterwards. AUC, ROC, thresholds and the confusion counts at a threshold are all
read from it. ``group`` is any list of columns: split, category group, class, predictor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagframe.functions.stats import chi2_pvalue, ratio
from bagframe.operators.hot import COUNT, attach
from bagframe.operators.permute import BLOCK_VALUES, permuted_statistic, slots
from bagframe.operators.scan import ordered_scan
from bagframe.session import cut_lineage

TINY = 1e-12


def score_counts(df: DataFrame, target: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """(group..., score, pos, neg) per distinct score. A missing or NaN score is an error."""
    s = F.col(score).cast("double")
    s = F.when(s.isNull() | F.isnan(s), F.raise_error(F.lit(f"missing or NaN values in {score}")).cast("double")
               ).otherwise(s)
    t = F.col(target).cast("int")
    return (df.select(*group, s.alias("score"), t.alias("__y"))
            .groupBy(*group, "score")
            .agg(F.sum(F.when(F.col("__y") == 1, 1).otherwise(0)).alias("pos"),
                 F.sum(F.when(F.col("__y") == 0, 1).otherwise(0)).alias("neg")))


def scan_scores(counts: DataFrame, group: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Cumulative positives/negatives from the highest score down."""
    return ordered_scan(counts, "score", group, ["pos", "neg"], next_cols=["pos", "neg"], descending=True,
                        blocks=blocks)


def midranks(df: DataFrame, value: str, group: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """(group..., value, n, midrank): the average 1-based rank of each distinct value."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    s = ordered_scan(counts, value, group, ["n"], blocks=blocks)
    return s.select(*group, value, "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("midrank"))


def _auc() -> Column:
    """Aggregate over a score scan: Mann-Whitney with ties counted one half."""
    wins = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    return ratio(F.sum(wins), F.max(F.col("total_pos").cast("double") * F.col("total_neg")))


def auc_from_scan(scan: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group..., auc, n_pos, n); the AUC is NULL when a group has only one class."""
    return scan.groupBy(*group).agg(
        _auc().alias("auc"), F.max("total_pos").alias("n_pos"), F.max(F.col("total_pos") + F.col("total_neg")).alias("n"))


def roc_auc(df: DataFrame, target: str, score: str, group: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    return auc_from_scan(scan_scores(score_counts(df, target, score, group), group, blocks), group)


def unpivot_scores(df: DataFrame, target: str, predictors: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep..., predictor, target, score) for evaluating several score columns in one plan."""
    pairs = F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).cast("double").alias("score"))
                      for p in predictors])
    return df.select(*keep, F.col(target).alias("target"), F.explode(pairs).alias("__p")).select(
        *keep, "__p.predictor", "target", "__p.score")


def auc_by_predictor(df: DataFrame, target: str, predictors: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    long = unpivot_scores(df, target, predictors, group)
    return roc_auc(long, "target", "score", [*group, "predictor"])


def _is_first() -> Column:
    return F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")


def _is_kept() -> Column:
    """Whether a scan row stays on the ROC curve when equally spaced collinear points are left out."""
    same = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
    return _is_first() | F.col("next_pos").isNull() | ~same


def _start_threshold(top_score: Column) -> Column:
    return F.when(top_score < 1, F.lit(1.0)).otherwise(F.lit(float("inf")))


def roc_from_scan(scan: DataFrame, group: Sequence[str] = (), drop_intermediate: bool = True) -> DataFrame:
    """ROC points (group..., threshold, tps, fps, tpr, fpr) from a score scan.

    With ``drop_intermediate`` a point is left out when the following point adds the same number of positives and
    negatives (the three points are collinear and equally spaced), as the reference's ROC does before it searches a
    threshold; the first and last points always stay. The starting point (0, 0) has threshold infinity, or 1 when
    all scores are below 1.
    """
    if drop_intermediate:
        scan = scan.where(_is_kept())
    zero = F.lit(0).cast("long")
    point = F.struct(F.col("score").alias("threshold"), F.col("cum_pos").cast("long").alias("tps"),
                     F.col("cum_neg").cast("long").alias("fps"))
    origin = F.struct(_start_threshold(F.col("score")).alias("threshold"), zero.alias("tps"), zero.alias("fps"))
    points = F.when(_is_first(), F.array(origin, point)).otherwise(F.array(point))
    return scan.select(*group, "total_pos", "total_neg", F.explode(points).alias("p")).select(
        *group, "p.threshold", "p.tps", "p.fps", ratio(F.col("p.tps"), F.col("total_pos")).alias("tpr"),
        ratio(F.col("p.fps"), F.col("total_neg")).alias("fpr"))


def roc_curve(df: DataFrame, target: str, score: str, group: Sequence[str] = (), drop_intermediate: bool = True,
              blocks: int | None = None) -> DataFrame:
    scan = scan_scores(score_counts(df, target, score, group), group, blocks)
    return roc_from_scan(scan, group, drop_intermediate)


def criterion_value(criterion: str, weight: Column | float | None, tpr: Column, fpr: Column) -> Column:
    """Threshold criterion: g-mean or Youden. ``weight`` is the weight of sensitivity over specificity."""
    tnr = 1 - fpr
    if weight is None:
        return F.sqrt(tpr * tnr) if criterion == "gmean" else tpr - fpr
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    w_sens = w / (w + 1)
    if criterion == "gmean":
        return F.exp(w_sens * F.log(tpr + TINY) + (1 - w_sens) * F.log(tnr + TINY))
    return 2 * (w_sens * tpr + (1 - w_sens) * tnr) - 1


def _candidate(criterion: str, weight: Column | float | None, threshold: Column, tpr: Column, fpr: Column) -> Column:
    """Ordered so that the maximum is the best criterion, then the highest threshold."""
    value = F.round(criterion_value(criterion, weight, tpr, fpr), 12)
    return F.struct(value.alias("criterion"), threshold.alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"))


def best_threshold(roc: DataFrame, group: Sequence[str] = (), criterion: str = "gmean",
                   weight: Column | float | None = None) -> DataFrame:
    """(group..., threshold, criterion, tpr, fpr) at the maximum; ties go to the highest threshold."""
    best = F.max(_candidate(criterion, weight, F.col("threshold"), F.col("tpr"), F.col("fpr")))
    scored = roc.where(F.col("tpr").isNotNull() & F.col("fpr").isNotNull())
    return scored.groupBy(*group).agg(best.alias("b")).select(
        *group, "b.threshold", "b.criterion", "b.tpr", "b.fpr")


def group_statistics(scan: DataFrame, group: Sequence[str] = (), criterion: str = "gmean",
                     weight: Column | float | None = None) -> DataFrame:
    """(group..., auc, best) in one aggregate over a score scan: AUC and the best ROC point as a struct (criterion,
    threshold, tpr, fpr); both NULL with one class only."""
    tpr, fpr = ratio(F.col("cum_pos"), F.col("total_pos")), ratio(F.col("cum_neg"), F.col("total_neg"))
    usable = _is_kept() & (F.col("total_pos") > 0) & (F.col("total_neg") > 0)
    a = scan.groupBy(*group).agg(
        _auc().alias("auc"), F.max("score").alias("__top"),
        F.max(F.when(usable, _candidate(criterion, weight, F.col("score"), tpr, fpr))).alias("__best"))
    origin = _candidate(criterion, weight, _start_threshold(F.col("__top")), F.lit(0.0), F.lit(0.0))
    return a.select(*group, "auc", F.when(F.col("__best").isNotNull(), F.greatest("__best", origin)).alias("best"))


def threshold_scores(score: str, threshold: Column | float) -> Column:
    """0/1 prediction: at or above the threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (F.col(score) >= t).cast("int")


def confusion_counts(df: DataFrame, target: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    t, p = F.col(target) == 1, F.col(pred) == 1
    return df.groupBy(*group).agg(
        F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))


def _threshold_counts() -> list[Column]:
    """Aggregates over score counts with a threshold column: confusion (>=) and strict contingency (>) counts."""
    at, over = F.col("score") >= F.col("threshold"), F.col("score") > F.col("threshold")

    def total(c: str, cond: Column) -> Column:
        return F.sum(F.when(cond, F.col(c)).when(~cond, 0)).cast("long")

    return [total("neg", ~at).alias("tn"), total("neg", at).alias("fp"), total("pos", ~at).alias("fn"),
            total("pos", at).alias("tp"), total("neg", ~over).alias("low_neg"), total("neg", over).alias("high_neg"),
            total("pos", ~over).alias("low_pos"), total("pos", over).alias("high_pos")]


def confusion_at(counts: DataFrame, thresholds: DataFrame, group: Sequence[str] = (),
                 on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Confusion counts and the strict (> threshold) contingency per group, from score counts.

    ``thresholds`` has one row per ``on`` (or a single row when ``on`` is empty). A group without a threshold (one
    class only) has NULL counts when it is kept by a left join.
    """
    if on:
        x = counts.join(thresholds.select(*on, "threshold"), list(on), how)
    else:
        x = counts.withColumn("threshold", thresholds.select("threshold").scalar())
    return x.groupBy(*group).agg(F.max("threshold").alias("threshold"), *_threshold_counts())


def binary_scores(tn: str = "tn", fp: str = "fp", fn: str = "fn", tp: str = "tp") -> list[Column]:
    """f1, acc, bacc, tpr, fpr, tnr, fnr, kappa, n, n_pos as expressions over confusion counts."""
    a, b, c, d = (F.col(x).cast("double") for x in (tn, fp, fn, tp))
    n, pos, neg = a + b + c + d, c + d, a + b
    recall = F.coalesce(ratio(d, pos), F.lit(0.0))
    classes = F.array_compact(F.array(ratio(d, pos), ratio(a, neg)))
    mean = F.aggregate(classes, F.lit(0.0), lambda s, v: s + v) / F.size(classes)
    agree, chance = ratio(a + d, n), ratio(pos * (b + d) + neg * (a + c), n * n)
    return [
        F.coalesce(ratio(2 * d, 2 * d + b + c), F.lit(0.0)).alias("f1"), agree.alias("acc"), mean.alias("bacc"),
        recall.alias("tpr"), ratio(b, neg).alias("fpr"), ratio(a, neg).alias("tnr"), ratio(c, pos).alias("fnr"),
        ratio(agree - chance, 1 - chance).alias("kappa"), n.cast("long").alias("n"), pos.cast("long").alias("n_pos")]


def _empty_margin(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether a row or column of [[a, b], [c, d]] sums to 0. The sums are compared one by one: their product passes 64 bits from about
    100 000 rows on."""
    return (a + b == 0) | (c + d == 0) | (a + c == 0) | (b + d == 0)


def chi_square_2x2(a: Column, b: Column, c: Column, d: Column, correction: bool = True) -> Column:
    """Chi-square statistic of [[a, b], [c, d]] with Yates correction; 0 when a row or column is empty."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    stat = F.lit(0.0)
    for obs, row, col in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        expected = row * col / n
        off = F.abs(obs - expected)
        if correction:
            off = off - F.least(F.lit(0.5), off)
        stat = stat + F.try_divide(off * off, expected)
    return F.when(_empty_margin(a, b, c, d), F.lit(0.0)).otherwise(stat)


def chi_square_test(df: DataFrame, target: str, score: str, threshold: Column | float, group: Sequence[str] = (),
                    low: str = "low", high: str = "high") -> DataFrame:
    """Target against (score > threshold), strictly greater: contingency counts, statistic, dof and p-value."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    y, over = F.col(target) == 1, F.col(score) > t
    c = df.groupBy(*group).agg(
        F.count_if(~y & ~over).alias(f"no_{low}"), F.count_if(~y & over).alias(f"no_{high}"),
        F.count_if(y & ~over).alias(f"yes_{low}"), F.count_if(y & over).alias(f"yes_{high}"))
    cells = [F.col(x) for x in (f"no_{low}", f"no_{high}", f"yes_{low}", f"yes_{high}")]
    return _with_chi2(c, cells, "statistic", "dof", "p")


def _with_chi2(df: DataFrame, cells: list[Column], stat: str, dof: str, p: str) -> DataFrame:
    df = df.withColumn(stat, chi_square_2x2(*cells)).withColumn(dof, F.when(_empty_margin(*cells), 0).otherwise(1).cast("int"))
    return df.withColumn(p, chi2_pvalue(F.col(stat), F.col(dof)))


def binary_report(df: DataFrame, target: str, score: str, group: Sequence[str] = (), **options) -> DataFrame:
    """AUC, threshold, chi-square p and confusion metrics per group, from one pass over the rows.

    Options are those of :func:`report_from_counts`.
    """
    return report_from_counts(score_counts(df, target, score, group), group, **options)


def report_from_counts(counts: DataFrame, group: Sequence[str] = (), threshold: float | None = None,
                       threshold_from: Column | None = None, threshold_on: Sequence[str] = (),
                       criterion: str = "gmean", weight: Column | float | None = None,
                       blocks: int | None = None) -> DataFrame:
    """The binary report from score counts.

    The threshold is given; or found on the groups selected by ``threshold_from`` (a condition over the group
    columns, such as split = 'validation'), one per value of ``threshold_on``, and reused in all groups; or found
    in every group.
    """
    group = list(group)
    # one scan gives the AUC and the best point; the counts at a threshold need no order, so they come from the score counts
    stats = group_statistics(scan_scores(counts, group, blocks), group, criterion, weight)
    if threshold is not None:
        x = counts.withColumn("threshold", F.lit(float(threshold)))
    else:
        if threshold_from is not None:
            # a condition inside the aggregate, not a filter: a filter would be pushed below the scan and make Spark
            # compute the scan a second time for the chosen groups
            on = list(threshold_on)
            found = stats.groupBy(*on).agg(F.max(F.when(threshold_from, F.col("best")))["threshold"].alias("threshold"))
        else:
            on, found = group, stats.select(*group, F.col("best.threshold").alias("threshold"))
        x = counts.join(found, on, "left") if on else counts.withColumn("threshold", found.scalar())
    rep = x.groupBy(*group).agg(F.max("threshold").alias("threshold"), *_threshold_counts())
    auc = stats.select(*group, "auc")
    rep = rep.join(auc, group) if group else rep.withColumn("auc", auc.scalar())
    cells = [F.col(c) for c in ("low_neg", "high_neg", "low_pos", "high_pos")]
    rep = _with_chi2(rep, cells, "chi2", "chi2_dof", "p_thresh")
    return rep.select(*group, "threshold", "tn", "fp", "fn", "tp", "chi2", "p_thresh", *binary_scores(), "auc")


def calibration(df: DataFrame, target: str, score: str, group: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Uniform bins over [0, 1]: mean score and share of positives; empty bins are absent. An edge goes to the
    lower bin."""
    s = F.col(score).cast("double")
    inner = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    bin_ = F.size(F.filter(inner, lambda e: e < s))
    return df.groupBy(*group, bin_.alias("bin")).agg(
        F.avg(s).alias("mean_predicted"), F.avg(F.col(target).cast("double")).alias("fraction_positive"),
        F.count(F.lit(1)).alias("n"))


def brier_score(target: str, score: str) -> Column:
    d = F.col(score).cast("double") - F.col(target)
    return F.avg(d * d)


def auc_permutation_test(df: DataFrame, target: str, score: str, id_col: str, permutations: int = 2000, seed: int = 1,
                         blocks: int | None = None, block_values: int = BLOCK_VALUES) -> DataFrame:
    """p = (#{permuted AUC >= AUC} + 1) / (permutations + 1).

    Permuting labels means giving each positive row another row's midrank: with P positives only the sum of P midranks matters, of the
    rows that :func:`permuted_statistic` names. Midranks are multiples of a half, so their sums are exact.
    """
    ranks = midranks(df.withColumn("__s", F.col(score).cast("double")), "__s", blocks=blocks)
    ranks = ranks.select("__s", F.col("n").alias(COUNT), "midrank")
    rows = attach(df.select(F.col(id_col).alias("__id"), F.col(score).cast("double").alias("__s"), F.col(target).cast("long").alias("__y")), ranks, ["__s"])
    rows = cut_lineage(slots(rows, "__id", blocks))                # read as rows, as partners and for the base
    base = rows.agg(F.sum("__y").alias("p"), F.count(F.lit(1)).alias("n"),
                    F.sum(F.when(F.col("__y") == 1, F.col("midrank"))).alias("r"))
    sums = permuted_statistic(rows, F.lit(1), F.col("midrank"), F.col("__y") == 1, F.sum("b"), permutations, seed, block_values)
    hits = sums.withColumn("r", base.select("r").scalar()).agg(F.count_if(F.col("s") >= F.col("r")).alias("hits"))
    pn = F.col("p") * (F.col("n") - F.col("p"))
    return base.withColumn("hits", hits.scalar()).select(
        ratio(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, pn).alias("auc"), F.col("n"),
        F.lit(permutations).alias("permutations"),
        ((F.col("hits") + 1.0) / (permutations + 1.0)).alias("p"))


def permutation_test(df: DataFrame, v1: str, v2: str, id_col: str, statistic, permutations: int = 2000, seed: int = 1,
                     blocks: int | None = None, block_values: int = BLOCK_VALUES) -> DataFrame:
    """Permutation test of a user statistic: ``statistic(Column, Column) -> aggregate Column``, e.g. ``F.corr``.

    v1 is permuted against v2 by :func:`permuted_statistic`: no row is ordered or shuffled per permutation.
    """
    score = statistic(F.col("a"), F.col("b"))
    rows = df.select(F.col(id_col).alias("__id"), F.col(v1).alias("a"), F.col(v2).alias("b"))
    rows = cut_lineage(slots(rows, "__id", blocks))
    scores = permuted_statistic(rows, F.col("a"), F.col("b"), F.lit(True), score, permutations, seed, block_values)
    base = rows.agg(score.alias("score"), F.count(F.lit(1)).alias("n"))
    hits = scores.withColumn("score", base.select("score").scalar()).agg(
        F.count_if(F.round("s", 12) >= F.round("score", 12)).alias("hits"))          # equal up to the order of summing
    return base.withColumn("hits", hits.scalar()).select(
        "score", "n", F.lit(permutations).alias("permutations"),
        ((F.col("hits") + 1.0) / (permutations + 1.0)).alias("p"))
