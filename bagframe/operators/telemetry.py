"""Training history as tables: (run, epoch, seq, metric, value) events to one row per epoch, best and stop epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagframe.operators.spec import TrainType


def clean_metrics(events: DataFrame, ignore: Sequence[str] = ("_step",)) -> DataFrame:
    """Drop metrics whose name contains an ignored text; a run's only ``lr-*`` metric becomes ``lr``."""
    for text in ignore:
        events = events.where(~F.col("metric").contains(text))
    rates = events.where(F.col("metric").startswith("lr-")).groupBy("run").agg(
        F.min("metric").alias("__lo"), F.max("metric").alias("__hi"))
    x = events.join(rates, "run", "left")
    single = (F.col("metric") == F.col("__lo")) & (F.col("__lo") == F.col("__hi"))
    return x.withColumn("metric", F.when(single, F.lit("lr")).otherwise(F.col("metric"))).drop("__lo", "__hi")


def last_values(events: DataFrame, keys: Sequence[str] = ("run", "epoch", "metric")) -> DataFrame:
    """The last logged value per key."""
    return events.groupBy(*keys).agg(F.max_by("value", "seq").alias("value"))


def epoch_table(events: DataFrame, metrics: Sequence[str], fill_last: str | None = "lr") -> DataFrame:
    """One row per (run, epoch), one column per metric with its last value. The final epoch of a run takes the
    previous epoch's ``fill_last`` value when its own was not logged."""
    wide = events.groupBy("run", "epoch").agg(
        *[F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, F.col("seq"))).alias(m)
          for m in metrics])
    if fill_last is None or fill_last not in metrics:
        return wide
    w = Window.partitionBy("run").orderBy("epoch")  # epochs of one run: a short list
    last = F.lead("epoch").over(w).isNull()
    return wide.withColumn(fill_last, F.when(last, F.coalesce(F.col(fill_last), F.lag(fill_last).over(w))).otherwise(
        F.col(fill_last)))


def phase_means(events: DataFrame, group: Sequence[str] = ("run", "epoch", "metric")) -> DataFrame:
    return events.groupBy(*group).agg(F.avg("value").alias("mean"))


def sort_by_metric(df: DataFrame, metric: str, *ties: str) -> DataFrame:
    """Best row first: ascending when the name contains err or loss, else descending."""
    low = any(t in metric.lower() for t in ("err", "loss"))
    return df.orderBy(F.col(metric).asc() if low else F.col(metric).desc(), *ties)


def best_epochs(table: DataFrame, monitor: str | None = None, mode: str | None = None, patience: int = 25,
                train_type: TrainType | str = TrainType.CLF) -> DataFrame:
    """(run, best_epoch, best_value, stop_epoch): the first epoch with the best value, and the epoch where training
    stops after ``patience`` epochs without a new best (the last epoch otherwise)."""
    name, default = TrainType(train_type).monitor
    monitor, mode = monitor or name, mode or default
    v: Column = F.col(monitor) if mode == "max" else -F.col(monitor)
    x = table.where(F.col(monitor).isNotNull()).withColumn("__v", v)
    w = Window.partitionBy("run").orderBy("epoch")  # epochs of one run: a short list
    x = x.withColumn("__top", F.max("__v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("__new", F.col("__top").isNull() | (F.col("__v") > F.col("__top"))).withColumn(
        "__n", F.row_number().over(w))
    x = x.withColumn("__since", F.col("__n") - F.max(F.when(F.col("__new"), F.col("__n"))).over(w))
    stop = F.coalesce(F.min(F.when(F.col("__since") >= patience, F.col("epoch"))), F.max("epoch"))
    runs = x.groupBy("run").agg(stop.alias("stop_epoch"))
    seen = x.join(runs, "run").where(F.col("epoch") <= F.col("stop_epoch"))
    best = F.max(F.struct(F.col("__v"), (-F.col("epoch")).alias("e"), F.col(monitor).alias("value")))
    return seen.groupBy("run").agg(best.alias("b"), F.max("stop_epoch").alias("stop_epoch")).select(
        "run", (-F.col("b.e")).alias("best_epoch"), F.col("b.value").alias("best_value"), "stop_epoch")
