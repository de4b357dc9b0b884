"""Sample weights and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagframe.functions import labels as L
from bagframe.functions.stats import ratio
from bagframe.operators.hot import COUNT, attach
from bagframe.operators.profile import label_ratios, target_values
from bagframe.operators.scan import exact_quantiles, hash60, hash_position, ordered_scan
from bagframe.operators.spec import CohortSpec
from bagframe.session import default_blocks


def class_weights(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """Add ``weight`` = 1 / (smallest ratio among the row's labels). A row without a label has a NULL weight.

    The ratio table has one row per class, so it travels as a single map value.
    """
    ratios = label_ratios(df, spec).agg(F.map_from_entries(F.collect_list(F.struct("label", "ratio")))).scalar()
    x = df.withColumn("__r", ratios)
    mine = F.transform(L.label_indices(spec.target_cols), lambda k: F.try_element_at(F.col("__r"), k))
    return x.withColumn("weight", ratio(1, F.array_min(mine))).drop("__r")


def column_weights(df: DataFrame, col: str) -> DataFrame:
    """Add ``weight`` = rows / rows with the same value."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("__c"))
    total = c.where(F.col(col).isNotNull()).agg(F.sum("__c")).scalar()
    return attach(df, c.select(col, F.col("__c").alias(COUNT), ratio(total, F.col("__c")).alias("weight")), [col], "left")


def survival_weights(df: DataFrame, spec: CohortSpec, bins: int = 4) -> DataFrame:
    """Add ``bin`` and ``weight`` = 1 / share of the row's duration bin.

    Edges are exact quantiles of the durations of uncensored rows, the first edge is 0 and the last bin is open; an
    edge belongs to the bin it starts.
    """
    d = F.col(spec.duration_col)
    events = df.where(F.col(spec.event_col) == 1)
    q = exact_quantiles(events, spec.duration_col, [i / bins for i in range(bins)]).scalar()
    x = df.withColumn("__q", q)
    edges = F.transform("__q", lambda e, i: F.when(i == 0, F.lit(0.0)).otherwise(e))
    x = x.withColumn("bin", F.size(F.filter(edges, lambda e: e <= d)).cast("int")).drop("__q")
    sizes = x.groupBy("bin").agg(F.count(F.lit(1)).alias("__c"))
    total = sizes.agg(F.sum("__c")).scalar()
    return attach(x, sizes.select("bin", F.col("__c").alias(COUNT), ratio(total, F.col("__c")).alias("weight")), ["bin"])


def equal_cell_sample(df: DataFrame, spec: CohortSpec, n: int = 20, seed: int = 1) -> DataFrame:
    """About ``n`` rows, the same number from every non-empty (split, category, label) cell; a smaller cell gives all
    its rows. Fewer than one row per cell is an error."""
    cells = (target_values(df, spec).count() * df.select(spec.split_col).distinct().count()
             * df.select(spec.category_col).distinct().count())
    per_cell = round(n / cells)
    if per_cell < 1:
        raise ValueError(f"n={n} is too small for {cells} cells")
    x = df.withColumn("__label", L.argmax(spec.target_cols))
    x = hash_position(x, [spec.split_col, spec.category_col, "__label"], [spec.name_col], [F.lit(str(seed))], "__pos")
    return x.where(F.col("__pos") < per_cell).select(*df.columns)


def weighted_sample(df: DataFrame, weight: str, id_col: str, n: int, seed: int = 1, blocks: int | None = None) -> DataFrame:
    """``n`` draws with replacement, each row with probability weight / sum: the rows with a ``draw`` number.

    Rows own intervals of the running weight; draws are md5-uniform numbers. Both sides meet by equi-join on an
    interval bucket: a draw is in one bucket, a row in every bucket its interval touches, so a row with a third of
    the total weight is spread over a third of the buckets.
    """
    buckets = max(1, n)
    w = df.where(F.col(weight) > 0).groupBy(id_col).agg(F.max(F.col(weight).cast("double")).alias("__w"))
    w = w.withColumn("__h", hash60(F.lit(str(seed)), F.lit("order"), F.col(id_col).cast("string")))
    per_hash = w.groupBy("__h").agg(F.sum("__w").alias("__s"), F.collect_list(F.struct(id_col, "__w")).alias("__ids"))
    b = blocks or default_blocks(df.sparkSession)
    s = ordered_scan(per_hash, "__h", [], ["__s"], block_expr=(F.col("__h") / F.lit(float(1 << 60) / b)).cast("int"))
    total = F.col("total___s")
    # ids of equal hashes (about one pair per billion ids) share the interval in id order
    runs = F.aggregate(
        F.array_sort("__ids"), F.struct((F.col("cum___s") - F.col("__s")).alias("at"),
                                        F.array().cast(f"array<struct<id:{dict(df.dtypes)[id_col]},lo:double,hi:double>>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["__w"]).alias("at"), F.concat(acc["out"], F.array(F.struct(
            x[id_col].alias("id"), acc["at"].alias("lo"), (acc["at"] + x["__w"]).alias("hi")))).alias("out")))["out"]
    rows = s.select(F.explode(runs).alias("r"), total.alias("__total")).select("r.id", "r.lo", "r.hi", "__total")
    width = F.col("__total") / buckets
    rows = rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width),
                                                         F.floor(F.col("hi") / width))))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"))
    u = hash60(F.lit(str(seed)), F.lit("draw"), F.col("draw").cast("string")) / float(1 << 60)
    # the scan's own total, so that the last interval ends exactly where the draws do
    total_weight = s.agg(F.max("total___s")).scalar()
    draws = draws.withColumn("__u", u * total_weight).withColumn("bucket", F.floor(F.col("__u") / (total_weight / buckets)))
    hit = draws.join(rows, "bucket").where((F.col("lo") <= F.col("__u")) & (F.col("__u") < F.col("hi")))
    return df.join(hit.select("draw", F.col("id").alias(id_col)), id_col)


def shuffled(df: DataFrame, id_cols: Sequence[str], seed: int = 1) -> DataFrame:
    """Rows in a reproducible shuffled order."""
    return df.orderBy(hash60(F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]), *id_cols)
