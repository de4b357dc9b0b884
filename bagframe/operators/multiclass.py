"""Multiclass, multilabel and regression evaluation, and the evaluation of category groups in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagframe.functions import labels as L
from bagframe.functions.stats import ratio
from bagframe.operators import binary as B
from bagframe.operators.groups import Levels, Sizes, in_groups, memberships
from bagframe.operators.spec import CohortSpec, TrainType
from bagframe.session import cut_lineage


def class_scores(df: DataFrame, spec: CohortSpec, keep: Sequence[str] = (), outs: Sequence[str] | None = None) -> DataFrame:
    """One-vs-rest long form (keep..., class, target, score), one row per class."""
    outs = outs or spec.out_cols
    items = F.array(*[F.struct(F.lit(t).alias("class"), F.col(t).cast("int").alias("target"),
                               F.col(o).cast("double").alias("score")) for t, o in zip(spec.target_cols, outs)])
    return df.select(*keep, F.explode(items).alias("c")).select(*keep, "c.class", "c.target", "c.score")


def class_counts(df: DataFrame, spec: CohortSpec, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., class, score, pos, neg)."""
    return B.score_counts(class_scores(df, spec, keep), "target", "score", [*keep, "class"])


def class_thresholds(df: DataFrame, spec: CohortSpec, split: str = "validation", criterion: str = "gmean",
                     weights: dict[str, float] | None = None) -> DataFrame:
    """(class, threshold): one cut-off per class, found on one split. ``weights`` are sensitivity weights per class."""
    rows = df.where(F.col(spec.split_col) == split)
    scan = B.scan_scores(class_counts(rows, spec), ["class"])
    w = None
    if weights:
        w = reduce(lambda e, kv: e.when(F.col("class") == kv[0], F.lit(float(kv[1]))), weights.items(),
                   F.when(F.lit(False), F.lit(1.0))).otherwise(F.lit(1.0))
    stats = B.group_statistics(scan, ["class"], criterion, w)
    return stats.where(F.col("best").isNotNull()).select("class", F.col("best.threshold").alias("threshold"))


def class_report(df: DataFrame, spec: CohortSpec, group: Sequence[str] = ("split",), split: str = "validation",
                 ) -> DataFrame:
    """Binary report of every class against the rest, with the thresholds of one split reused in all groups.
    A class that does not occur in a group has a NULL AUC."""
    counts = class_counts(df, spec, group)
    return B.report_from_counts(counts, [*group, "class"], threshold_from=F.col(spec.split_col) == split,
                                threshold_on=["class"])


def macro_auc(class_auc: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean AUC over the classes that have one."""
    return class_auc.groupBy(*group).agg(F.avg("auc").alias("auc"))


def confusion_matrix(df: DataFrame, y_true: str | Column, y_pred: str | Column, n_classes: int,
                     group: Sequence[str] = ()) -> DataFrame:
    """(group..., y_true, y_pred, n) for all k x k cells, absent classes included."""
    t = F.col(y_true) if isinstance(y_true, str) else y_true
    p = F.col(y_pred) if isinstance(y_pred, str) else y_pred
    counts = df.groupBy(*group, t.cast("int").alias("y_true"), p.cast("int").alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))
    return complete_matrix(counts, n_classes, group)


def complete_matrix(counts: DataFrame, n_classes: int, group: Sequence[str] = ()) -> DataFrame:
    """Fill the missing cells of a long confusion matrix with 0: zero cells are generated per group and added up."""
    cells = F.sequence(F.lit(0), F.lit(n_classes - 1))
    zero = counts.groupBy(*group).agg(F.lit(0).cast("long").alias("n"))
    zero = zero.withColumn("y_true", F.explode(cells)).withColumn("y_pred", F.explode(cells))
    both = counts.unionByName(zero.select(*counts.columns))
    return both.groupBy(*group, "y_true", "y_pred").agg(F.sum("n").cast("long").alias("n"))


def normalise_matrix(cm: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Add the share of each cell in its row; a row without entries gives 0."""
    rows = cm.groupBy(*group, "y_true").agg(F.sum("n").alias("__row"))
    return cm.join(rows, [*group, "y_true"]).select(
        *cm.columns, F.coalesce(ratio(F.col("n"), F.col("__row")), F.lit(0.0)).alias("share"))


def matrix_class_metrics(cm: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group..., class, support, predicted, tp, total, f1, precision, tpr, tnr); undefined values are NULL."""
    sides = F.array(F.struct(F.col("y_true").alias("class"), F.col("n").alias("row"), F.lit(0).cast("long").alias("col")),
                    F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("long").alias("row"), F.col("n").alias("col")))
    tp = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    long = cm.select(*group, F.explode(sides).alias("s"), tp.alias("__tp"), "n").select(
        *group, "s.class", "s.row", "s.col", F.when(F.col("s.row") > 0, F.col("__tp")).otherwise(0).alias("__tp"))
    per = long.groupBy(*group, "class").agg(F.sum("row").alias("support"), F.sum("col").alias("predicted"),
                                            F.sum("__tp").alias("tp"))
    total = cm.groupBy(*group).agg(F.sum("n").alias("total"))
    per = per.join(total, list(group)) if group else per.withColumn("total", total.scalar())
    s, q, t, n = (F.col(c) for c in ("support", "predicted", "tp", "total"))
    return per.select(*group, "class", "support", "predicted", "tp", "total",
                      ratio(2 * t, s + q).alias("f1"), ratio(t, q).alias("precision"), ratio(t, s).alias("tpr"),
                      ratio(n - s - q + t, n - s).alias("tnr"))


def fleiss_band(kappa: Column) -> Column:
    """Verbal band of a kappa value at the cut-offs 0.40 and 0.75."""
    return F.when(kappa < 0.40, "Poor").when(kappa < 0.75, "Intermediate to Good").when(
        kappa.isNotNull(), "Excellent")


def weighted_kappa(cm: DataFrame, group: Sequence[str] = (), weights: str = "quadratic") -> DataFrame:
    """Cohen's kappa with quadratic, linear or no weights: 1 - sum(w * observed) / sum(w * expected)."""
    d = (F.col("y_true") - F.col("y_pred")).cast("double")
    w = {"quadratic": d * d, "linear": F.abs(d), "none": (d != 0).cast("double")}[weights]
    rows = cm.groupBy(*group, "y_true").agg(F.sum("n").alias("__r"))
    cols = cm.groupBy(*group, "y_pred").agg(F.sum("n").alias("__c"))
    x = cm.join(rows, [*group, "y_true"]).join(cols, [*group, "y_pred"])
    out = x.groupBy(*group).agg(F.sum(w * F.col("n")).alias("__o"), F.sum(w * F.col("__r") * F.col("__c")).alias("__e"),
                                F.sum("n").alias("__n"))
    return out.select(*group, (1 - ratio(F.col("__o") * F.col("__n"), F.col("__e"))).alias("kappa"))


def matrix_metrics(cm: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group..., n, acc, kappa, kappa_quadratic, f1_macro, f1_micro, f1_weighted, fleiss) from a long matrix.

    f1_macro is NULL when a class neither occurs nor is predicted.
    """
    per = matrix_class_metrics(cm, group)
    n = F.max("total")
    hits, chance = ratio(F.sum("tp"), n), ratio(F.sum(F.col("support") * F.col("predicted")), n * n)
    macro = F.when(F.count_if(F.col("f1").isNull()) == 0, F.avg("f1"))
    over = per.groupBy(*group).agg(
        n.alias("n"), hits.alias("acc"), ratio(hits - chance, 1 - chance).alias("kappa"), macro.alias("f1_macro"),
        hits.alias("f1_micro"),
        ratio(F.sum(F.coalesce("f1", F.lit(0.0)) * F.col("support")), n).alias("f1_weighted"))
    over = over.withColumn("fleiss", fleiss_band(F.col("kappa")))
    kq = weighted_kappa(cm, group).withColumnRenamed("kappa", "kappa_quadratic")
    return over.join(kq, list(group)) if group else over.withColumn("kappa_quadratic", kq.scalar())


def multilabel_predictions(df: DataFrame, spec: CohortSpec, thresholds: DataFrame) -> DataFrame:
    """Add pred0.. by thresholding every class at its own cut-off. ``thresholds`` has one row per class."""
    t = thresholds.agg(F.map_from_entries(F.collect_list(F.struct("class", "threshold")))).scalar()
    x = df.withColumn("__t", t)
    cols = {f"{spec.pred_prefix}{i}": (F.col(o) >= F.try_element_at(F.col("__t"), F.lit(c))).cast("int")
            for i, (c, o) in enumerate(zip(spec.target_cols, spec.out_cols))}
    return x.withColumns(cols).drop("__t")


def multilabel_matrices(df: DataFrame, spec: CohortSpec, group: Sequence[str] = ()) -> DataFrame:
    """(group..., class, tn, fp, fn, tp): the 2 x 2 matrix of every class, over targets and pred columns."""
    items = F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).cast("int").alias("t"),
                               F.col(f"{spec.pred_prefix}{i}").cast("int").alias("p"))
                      for i, c in enumerate(spec.target_cols)])
    long = df.select(*group, F.explode(items).alias("c")).select(*group, "c.class", "c.t", "c.p")
    return B.confusion_counts(long, "t", "p", [*group, "class"])


def multilabel_metrics(df: DataFrame, spec: CohortSpec, group: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Subset accuracy and micro/macro/weighted F1 over targets and pred columns; F1 of an empty class is 0. ``weight``: a column
    with the number of rows that a row stands for."""
    w = F.col(weight) if weight else F.lit(1).cast("long")

    def number(condition: Column) -> Column:
        return F.sum(F.when(condition, w).otherwise(0))

    equal = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"{spec.pred_prefix}{i}")
                                        for i, c in enumerate(spec.target_cols)])
    aggs = [F.sum(w).alias("n"), (number(equal) / F.sum(w)).alias("acc")]
    for i, c in enumerate(spec.target_cols):
        t, p = F.col(c) == 1, F.col(f"{spec.pred_prefix}{i}") == 1
        aggs += [number(t & p).alias(f"__tp{i}"), number(~t & p).alias(f"__fp{i}"), number(t & ~p).alias(f"__fn{i}")]
    a = df.groupBy(*group).agg(*aggs)
    k = range(spec.n_classes)
    f1 = [F.coalesce(ratio(2 * F.col(f"__tp{i}"), 2 * F.col(f"__tp{i}") + F.col(f"__fp{i}") + F.col(f"__fn{i}")),
                     F.lit(0.0)) for i in k]
    support = [F.col(f"__tp{i}") + F.col(f"__fn{i}") for i in k]

    def total(name: str) -> Column:
        return reduce(lambda x, y: x + y, [F.col(f"__{name}{i}") for i in k])

    tp, errors = total("tp"), total("fp") + total("fn")
    return a.select(
        *group, "n", "acc", F.coalesce(ratio(2 * tp, 2 * tp + errors), F.lit(0.0)).alias("f1_micro"),
        (reduce(lambda x, y: x + y, f1) / float(spec.n_classes)).alias("f1_macro"),
        F.coalesce(ratio(reduce(lambda x, y: x + y, [f * s for f, s in zip(f1, support)]),
                         reduce(lambda x, y: x + y, support)), F.lit(0.0)).alias("f1_weighted"))


def highest_label_matrix(df: DataFrame, spec: CohortSpec, group: Sequence[str] = (), none_class: int | None = None
                         ) -> DataFrame:
    """Multilabel read as multiclass: only the highest class of targets and predictions counts. A row without any
    label becomes the last class unless ``none_class`` is set."""
    preds = [f"{spec.pred_prefix}{i}" for i in range(spec.n_classes)]
    return confusion_matrix(df, L.highest_label(spec.target_cols, none_class), L.highest_label(preds, none_class),
                            spec.n_classes, group)


def category_prediction_matrix(df: DataFrame, spec: CohortSpec, pred: str, level: str | int = "",
                               group: Sequence[str] = ()) -> DataFrame:
    """(group..., category, label, one count column per class); only when every category has one true class,
    otherwise the group has no rows."""
    cat = F.col(spec.category(level)).alias("category")
    lab = L.argmax(spec.target_cols)
    m = df.groupBy(*group, cat).agg(F.min(lab).alias("label"), F.max(lab).alias("__hi"),
                                    *[F.count_if(F.col(pred) == k).alias(c) for k, c in enumerate(spec.target_cols)])
    mixed = m.where(F.col("label") != F.col("__hi"))
    if group:
        return m.join(mixed.select(*group).distinct(), list(group), "left_anti").drop("__hi")
    none = mixed.agg(F.count(F.lit(1))).scalar()
    return m.where(none == 0).drop("__hi")


def regression_metrics(df: DataFrame, targets: Sequence[str], outs: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """mse, rmse and r2 = 1 - SSE/SST, averaged over outputs. A constant target gives r2 1 if exact, else 0."""
    aggs = []
    for i, (t, o) in enumerate(zip(targets, outs)):
        y, e = F.col(t).cast("double"), F.col(t).cast("double") - F.col(o).cast("double")
        aggs += [F.avg(e * e).alias(f"__m{i}"), F.var_pop(y).alias(f"__v{i}")]
    a = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *aggs)
    k = float(len(targets))

    def mean(cols: list[Column]) -> Column:
        return reduce(lambda x, y: x + y, cols) / k

    idx = range(len(targets))
    r2 = [F.when(F.col(f"__v{i}") > 0, 1 - F.try_divide(F.col(f"__m{i}"), F.col(f"__v{i}"))).otherwise(
        F.when(F.col(f"__m{i}") == 0, 1.0).otherwise(0.0)) for i in idx]
    return a.select(*group, "n", mean([F.col(f"__m{i}") for i in idx]).alias("mse"),
                    mean([F.sqrt(f"__m{i}") for i in idx]).alias("rmse"), mean(r2).alias("r2"))


def evaluation_losses(df: DataFrame, logits: Sequence[str], targets: Sequence[str], label: str | None = None,
                      class_weights: Sequence[float] | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Cross-entropy (weighted mean over rows, when ``label`` is given) and BCE-with-logits (mean over all cells)."""
    w = F.array(*[F.lit(float(v)) for v in (class_weights or [1.0] * len(logits))])
    bce = reduce(lambda a, b: a + b, [L.bce_with_logits(F.col(z).cast("double"), F.col(t).cast("double")) * F.get(w, F.lit(i))
                                      for i, (z, t) in enumerate(zip(logits, targets))]) / float(len(logits))
    aggs = [F.avg(bce).alias("bce")]
    if label is not None:
        wy = F.get(w, F.col(label).cast("int"))
        aggs.append((F.sum(L.cross_entropy(logits, label) * wy) / F.sum(wy)).alias("cross_entropy"))
    return df.groupBy(*group).agg(*aggs)


def grouped_class_scores(df: DataFrame, logits: Sequence[str], targets: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Add ``group_logit`` = logits . weights and ``group_target`` = 1 when any weighted target is set."""
    if 0 not in list(weights):
        raise ValueError("at least one class needs weight 0 (the negative group)")
    z = L.dot(F.array(*[F.col(c).cast("double") for c in logits]), weights)
    t = L.dot(F.array(*[F.col(c).cast("double") for c in targets]), weights)
    return df.withColumns({"group_logit": z, "group_target": (t > 0).cast("int")})


GROUP = ["level", "category_group"]


def _member_counts(counts: DataFrame, spec: CohortSpec, members: Mapping[str, DataFrame], keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Counts per (split, categories..., keys) turned into counts per (split, group, keys): counts are multiplied, not rows."""
    grouped = in_groups(counts, spec, members).groupBy(spec.split_col, *GROUP, *keys)
    return grouped.agg(*[F.sum(c).alias(c) for c in sums])


def evaluate_binary(df: DataFrame, spec: CohortSpec, sizes: Mapping[str, Sizes] | Sizes = (1,), split: str = "validation",
                    levels: Levels = ("", 2, 3)) -> DataFrame:
    """Binary report for the whole table and all category groups of all levels, per split, in one plan.

    ``sizes`` says how many categories are combined (see :func:`bagframe.operators.groups.memberships`). Rows are first reduced to
    distinct scores per (split, categories); only that table is multiplied by the group memberships, and every metric is computed
    for all groups at once. Groups with one class have a NULL AUC.
    """
    members = memberships(df, spec, sizes, levels)
    cats = [spec.category(n) for n in members]
    counts = B.score_counts(df, spec.target_cols[-1], spec.out_cols[-1], [spec.split_col, *cats])
    counts = _member_counts(counts, spec, members, ["score"], ["pos", "neg"])
    whole = (F.col(spec.split_col) == split) & (F.col("level") == "all")
    return B.report_from_counts(counts, [spec.split_col, *GROUP], threshold_from=whole)


def evaluate_multiclass(df: DataFrame, spec: CohortSpec, sizes: Mapping[str, Sizes] | Sizes = (1,), levels: Levels = ("", 2, 3)) -> DataFrame:
    """Matrix metrics and macro AUC per split and category group in one plan (argmax predictions)."""
    if spec.train_type is not TrainType.CLF:
        raise ValueError("evaluate_multiclass needs a clf cohort")
    members = memberships(df, spec, sizes, levels)
    cats = [spec.category(n) for n in members]
    group = [spec.split_col, *GROUP]
    cm = df.groupBy(spec.split_col, *cats, L.argmax(spec.target_cols).alias("y_true"),
                    L.argmax(spec.out_cols).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    cm = _member_counts(cm, spec, members, ["y_true", "y_pred"], ["n"])
    over = matrix_metrics(complete_matrix(cm, spec.n_classes, group), group)
    counts = _member_counts(class_counts(df, spec, [spec.split_col, *cats]), spec, members, ["class", "score"], ["pos", "neg"])
    auc = B.auc_from_scan(B.scan_scores(counts, [*group, "class"]), [*group, "class"])
    return over.join(macro_auc(auc, group), group)


@dataclass(frozen=True)
class Evaluator:
    """A metric in three steps, so that no task ever needs a whole group: ``partial`` aggregates rows, ``merge`` aggregates partial
    results (default: their sums), ``finish`` turns merged ones into metrics. Each is name -> Column."""

    partial: Mapping[str, Column]
    finish: Mapping[str, Column]
    merge: Mapping[str, Column] | None = None

    def merged(self) -> list[Column]:
        merge = self.merge or {c: F.sum(c) for c in self.partial}
        return [e.alias(c) for c, e in merge.items()]


def evaluate_groups(df: DataFrame, spec: CohortSpec, evaluator: Evaluator, sizes: Mapping[str, Sizes] | Sizes = (1,), levels: Levels = ("", 2, 3),
                    before: Callable[[DataFrame], DataFrame] | None = None, after: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Any evaluator for the whole table and all category groups, per split. ``before`` changes the rows, ``after`` the report."""
    df = before(df) if before else df
    members = memberships(df, spec, sizes, levels)
    cats = [spec.category(n) for n in members]
    parts = df.groupBy(spec.split_col, *cats).agg(*[e.alias(c) for c, e in evaluator.partial.items()])
    group = [spec.split_col, *GROUP]
    out = in_groups(parts, spec, members).groupBy(*group).agg(*evaluator.merged()).select(*group, *[e.alias(c) for c, e in evaluator.finish.items()])
    return after(out) if after else out


def regression_evaluator(target: str, out: str) -> Evaluator:
    """n, mse, rmse and r2 (1 - SSE / SST; for a constant target 1 if exact, else 0)."""
    y = F.col(target).cast("double")
    e = y - F.col(out).cast("double")
    n, mse = F.col("n"), F.col("__ee") / F.col("n")
    spread = F.col("__yy") - F.col("__y") * F.col("__y") / n
    r2 = F.when(spread > 1e-12 * F.col("__yy"), 1 - F.try_divide(F.col("__ee"), spread)).otherwise(F.when(F.col("__ee") == 0, 1.0).otherwise(0.0))
    return Evaluator({"n": F.count(F.lit(1)), "__ee": F.sum(e * e), "__y": F.sum(y), "__yy": F.sum(y * y)},
                     {"n": n, "mse": mse, "rmse": F.sqrt(mse), "r2": r2})


def evaluate_multilabel(df: DataFrame, spec: CohortSpec, sizes: Mapping[str, Sizes] | Sizes = (1,), levels: Levels = ("", 2, 3)) -> DataFrame:
    """Subset accuracy and F1 scores per split and category group, from targets and pred columns: rows are reduced to distinct
    (target, prediction) patterns before they are multiplied."""
    members = memberships(df, spec, sizes, levels)
    cats = [spec.category(n) for n in members]
    preds = [f"{spec.pred_prefix}{i}" for i in range(spec.n_classes)]
    patterns = df.groupBy(spec.split_col, *cats, *spec.target_cols, *preds).agg(F.count(F.lit(1)).alias("__w"))
    counts = _member_counts(patterns, spec, members, [*spec.target_cols, *preds], ["__w"])
    return multilabel_metrics(counts, spec, [spec.split_col, *GROUP], weight="__w")


def evaluate_survival(df: DataFrame, spec: CohortSpec, score: str, sizes: Mapping[str, Sizes] | Sizes = (1,), levels: Levels = ("", 2, 3)) -> DataFrame:
    """(split, level, category_group, n, comparable, concordant, tied, cind): concordance of a score for the whole table and per category group.

    Pairs are counted once per pair of categories that some group holds; a group's index is made of the sums of its members' cells, so
    rows are not multiplied by groups.
    """
    from bagframe.operators.survival import concordance, concordance_between, harrell

    split, counts = spec.split_col, ["comparable", "concordant", "tied"]
    # read many times below: whatever made the table is run once
    categories = [spec.category(n) for n in levels if spec.category(n) in df.columns]
    df = cut_lineage(df.select(*dict.fromkeys([split, *categories, *spec.target_cols, spec.duration_col, spec.event_col, score])))
    members = memberships(df, spec, sizes, levels)
    whole = concordance(df, spec.duration_col, spec.event_col, score, [split]).drop("cind")
    out = df.groupBy(split).agg(F.count(F.lit(1)).alias("n")).join(whole, split, "left")
    out = out.select(split, F.lit("all").alias("level"), F.lit("all").alias("category_group"), "n", *counts)
    for n, table in members.items():
        first = table.select("level", "category_group", F.col("category").alias("a"))
        both = first.join(table.select("level", "category_group", F.col("category").alias("b")), GROUP)
        cells = concordance_between(df, spec.duration_col, spec.event_col, score, spec.category(n), both, [split])
        sums = both.join(cells, ["a", "b"]).groupBy(split, *GROUP).agg(*[F.sum(c).alias(c) for c in counts])
        rows = df.groupBy(split, F.col(spec.category(n)).alias("category")).agg(F.count(F.lit(1)).alias("n"))
        rows = rows.join(table, "category").groupBy(split, *GROUP).agg(F.sum("n").alias("n"))
        out = out.unionByName(rows.join(sums, [split, *GROUP], "left").select(split, *GROUP, "n", *counts))
    return out.select(split, *GROUP, "n", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts]).withColumn("cind", harrell())


def to_long_metrics(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., metric, value): numeric columns of a report as rows."""
    numeric = [f.name for f in report.schema.fields if f.name not in keys and
               f.dataType.typeName() in ("double", "float", "long", "integer", "bigint", "int")]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric])
    return report.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.metric", "p.value")


def user_evaluation(df: DataFrame, group: Sequence[str], partial, schema: str, merge: Mapping[str, Column], finish: Mapping[str, Column]) -> DataFrame:
    """A user's pandas evaluator without a limit on the size of a group.

    ``partial`` turns a pandas frame with any rows of any groups into rows of (group..., partial results) with the given schema; it sees one
    Arrow batch at a time. Spark merges them with the aggregates of ``merge``, and ``finish`` gives the metrics.
    """
    def batches(frames: Iterator) -> Iterator:
        for pdf in frames:
            if len(pdf):
                yield partial(pdf)

    merged = df.mapInPandas(batches, schema).groupBy(*group).agg(*[e.alias(c) for c, e in merge.items()])
    return merged.select(*group, *[e.alias(c) for c, e in finish.items()])
