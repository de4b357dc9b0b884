"""Attention pooling of bags: masking, top-k, softmax, bag vectors, heads, peaks, pooling, fitting.

Per-bag maxima and sums are aggregates (map-side partial sums) that are joined back by :mod:`bagframe.operators.hot`, which spreads the
rows of a hot bag; there are no windows over whole bags. Top-k uses row_number with a limit, which Spark applies per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from bagframe.functions import labels as L
from bagframe.functions.stats import ratio
from bagframe.operators.hot import with_stats
from bagframe.operators.tiles import is_background
from bagframe.session import cut_lineage

MAX_MODEL_BYTES = 256 << 20


def _gated_attention(x: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """[rows, heads]: w . (tanh(V x + b) * sigmoid(U x + c)) + d."""
    gate = 1.0 / (1.0 + np.exp(-(x @ m["U"].T + m["c"])))
    a = (np.tanh(x @ m["V"].T + m["b"]) * gate) @ m["w"].T
    return a + m["d"] if "d" in m else a


def _shared_weights(tiles: DataFrame, weights: dict[str, np.ndarray]):
    if sum(a.nbytes for a in weights.values()) > MAX_MODEL_BYTES:
        raise ValueError("attention weights are too large to broadcast")
    return tiles.sparkSession.sparkContext.broadcast(weights)


def attention_logits(tiles: DataFrame, weights: dict[str, np.ndarray], feat: str = "feat") -> DataFrame:
    """Long table (tile columns..., cls, a_raw) of gated attention, one row per tile and head.

    ``weights``: V, U of shape [hidden, dim], b, c [hidden], w [heads, hidden], optional d [heads]. They are a
    broadcast variable of checked size; vectors go through NumPy in Arrow batches.
    """
    shared = _shared_weights(tiles, weights)

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            if len(s) == 0:
                yield pd.Series([], dtype=object)
            else:
                yield pd.Series(list(_gated_attention(np.stack(s.to_numpy()).astype(np.float64), shared.value)))

    tiles = tiles.drop("cls")
    return tiles.withColumn("__a", logits(F.col(feat))).select(*tiles.columns, F.posexplode("__a").alias("cls", "a_raw"))


STEP = 50.0


def pool_with_attention(tiles: DataFrame, weights: dict[str, np.ndarray], dim: int, temperature: float = 1.0,
                        mask: bool = True, feat: str = "feat") -> DataFrame:
    """(name, cls, m, top, total): attention-pooled vectors of all bags in one pass over the tile vectors.

    Softmax pooling is a ratio of sums, so it can be merged: every Arrow batch computes attention, masks background
    and adds up exp(a - top) and exp(a - top) * x per bag, where top is the batch maximum rounded up to a multiple of
    50. Sums with the same top simply add; the few different tops of a bag are rescaled at the end. The vectors are
    read once, and the shuffle carries one row per bag and batch instead of the tiles. ``top`` and ``total`` give the
    softmax of any tile as exp(a - top) / total. Bags without unmasked tiles are absent.
    """
    shared = _shared_weights(tiles, weights)
    name = tiles.schema["name"]
    schema = T.StructType([name, T.StructField("cls", T.IntegerType()), T.StructField("top", T.DoubleType()),
                           T.StructField("s", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["__f"].to_numpy()).astype(np.float64)
            keep = x.max(1) != x.min(1) if mask else np.ones(len(x), bool)
            a = _gated_attention(x, shared.value) / temperature
            rows = []
            for key, at in pdf.groupby("name", sort=False).indices.items():
                at = at[keep[at]]
                if len(at) == 0:
                    continue
                top = np.ceil(a[at].max(0) / STEP) * STEP
                e = np.exp(a[at] - top)
                rows += [(key, c, top[c], e[:, c].sum(), e[:, c] @ x[at]) for c in range(a.shape[1])]
            yield pd.DataFrame(rows, columns=schema.names)

    parts = tiles.select("name", F.col(feat).alias("__f")).mapInPandas(partial, schema)
    cells = parts.select("name", "cls", "top", F.posexplode(F.concat(F.array("s"), "v")).alias("pos", "x")).groupBy(
        "name", "cls", "top", "pos").agg(F.sum("x").alias("x"))
    sums = cells.groupBy("name", "cls", "top").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("__c")).select(
        "name", "cls", "top", F.col("__c")[0]["x"].alias("s"), F.transform(F.slice("__c", 2, dim), lambda c: c["x"]).alias("v"))
    # the tops of a bag differ by multiples of 50: a handful of rows
    bag = sums.groupBy("name", "cls").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "s", "v")).alias("__p"))
    scaled = F.transform("__p", lambda p: F.struct((p["s"] * F.exp(p["top"] - F.col("top"))).alias("s"),
                                                   F.transform(p["v"], lambda x: x * F.exp(p["top"] - F.col("top"))).alias("v")))
    zero = F.struct(F.lit(0.0).alias("s"), F.array_repeat(F.lit(0.0), dim).alias("v"))
    total = F.aggregate(scaled, zero, lambda t, p: F.struct((t["s"] + p["s"]).alias("s"), F.zip_with(
        t["v"], p["v"], lambda x, y: x + y).alias("v")))
    bag = bag.select("name", "cls", "top", total.alias("__t"))
    return bag.select("name", "cls", F.transform("__t.v", lambda x: x / F.col("__t.s")).alias("m"), "top", F.col("__t.s").alias("total"))


def tile_attention(tiles: DataFrame, weights: dict[str, np.ndarray], bags: DataFrame, temperature: float = 1.0,
                   mask: bool = True) -> DataFrame:
    """(name, cls, i, j, a_raw, a_soft) from the bag totals of :func:`pool_with_attention`: no second sum over bags."""
    att = attention_logits(tiles, weights)
    if mask:
        att = mask_background(att)
    att = att.select("name", "cls", "i", "j", "a_raw").join(bags.select("name", "cls", "top", "total"), ["name", "cls"], "left")
    soft = F.when(F.abs("a_raw") < float("inf"), F.exp(F.col("a_raw") / temperature - F.col("top")) / F.col("total")).otherwise(
        F.when(F.col("total").isNotNull(), 0.0))
    return att.select("name", "cls", "i", "j", "a_raw", soft.alias("a_soft"))


def mask_background(att: DataFrame, feat: str = "feat", value: str = "a_raw") -> DataFrame:
    """Background tiles get attention -infinity."""
    return att.withColumn(value, F.when(is_background(feat), F.lit(float("-inf"))).otherwise(F.col(value)))


def top_k(df: DataFrame, value: str, k: int, group: Sequence[str], order: Sequence[str] = ("i", "j"),
          largest: bool = True) -> DataFrame:
    """The k rows of every group with the largest (smallest) value; ties in ``order``."""
    o = F.col(value).desc() if largest else F.col(value).asc()
    w = Window.partitionBy(*group).orderBy(o, *order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keep_top_k(att: DataFrame, k: int, value: str = "a_raw", group: Sequence[str] = ("name", "cls")) -> DataFrame:
    """All but the k largest attentions of a bag become -infinity; a bag with at most k tiles is unchanged.

    The k kept cells are found with a limited row_number and joined back, so a hot bag is not sorted in one task.
    """
    best = top_k(att, value, k, group).select(*group, "i", "j", F.lit(True).alias("__keep"))
    return att.join(best, [*group, "i", "j"], "left").withColumn(
        value, F.when(F.col("__keep"), F.col(value)).otherwise(F.lit(float("-inf")))).drop("__keep")


def attention_softmax(att: DataFrame, temperature: float | str | None = None, value: str = "a_raw", out: str = "a_soft",
                      group: Sequence[str] = ("name", "cls"), few_rows: bool = False) -> DataFrame:
    """Softmax over the tiles of a bag. ``temperature`` is a number or 'sqrt' (root of the number of finite values).
    A bag without finite attention gets NULL. ``few_rows`` promises that groups are short (after a top-k), so that
    windows can replace the aggregates and the input is computed once."""
    group = list(group)
    finite = F.abs(F.col(value)) < float("inf")
    if few_rows:
        w = Window.partitionBy(*group)
        count = F.count_if(finite).over(w)
        scale = F.sqrt(count.cast("double")) if temperature == "sqrt" else F.lit(float(temperature or 1.0))
        e = F.when(finite, F.exp((F.col(value) - F.max(value).over(w)) / scale)).otherwise(0.0)
        x = att.withColumn("__e", F.when(count > 0, e))
        return x.withColumn(out, ratio(F.col("__e"), F.sum("__e").over(w))).drop("__e")
    x = with_stats(att, group, __max=F.max(value), __fin=F.count_if(finite))
    scale = F.sqrt(F.col("__fin").cast("double")) if temperature == "sqrt" else F.lit(float(temperature or 1.0))
    e = F.when(finite, F.exp((F.col(value) - F.col("__max")) / scale)).otherwise(0.0)
    x = x.withColumn("__e", F.when(F.col("__fin") > 0, e))
    return with_stats(x, group, __sum=F.sum("__e")).withColumn(out, ratio(F.col("__e"), F.col("__sum"))).drop("__max", "__fin", "__e", "__sum")


def sum_heads(att: DataFrame, value: str = "a_soft") -> DataFrame:
    """Add up the heads of a tile into head 0."""
    rest = [c for c in att.columns if c not in ("cls", value, "a_raw", "name", "i", "j")]
    return att.groupBy("name", "i", "j").agg(F.sum(value).alias(value), *[F.any_value(c).alias(c) for c in rest]
                                             ).withColumn("cls", F.lit(0))


def _batch_vectors(df: DataFrame, group: list[str], feat: str, out: str, reduce, merge, weight: str | None = None) -> DataFrame:
    """(group..., out, n) for vectors of any width: NumPy reduces each group of an Arrow batch to one vector, and Spark merges those by
    position. A task sends one vector per group and batch."""
    schema = T.StructType([*[df.schema[c] for c in group], T.StructField("part", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, g in pdf.groupby(group, sort=False, dropna=False):
                rows.append((*key, reduce(np.stack(g["__f"].to_numpy()).astype(np.float64), g["__w"].to_numpy(dtype=np.float64)), len(g)))
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    parts = df.select(*group, F.col(feat).alias("__f"), w.alias("__w")).mapInPandas(partial, schema)
    cells = parts.select(*group, "n", F.posexplode("part").alias("pos", "v")).groupBy(*group, "pos").agg(merge("v").alias("v"), F.sum("n").alias("n"))
    return cells.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias(out), F.max("n").alias("n"))


def bag_vectors(att: DataFrame, dim: int, weight: str = "a_soft", feat: str = "feat", group: Sequence[str] = ("name", "cls")) -> DataFrame:
    """(group..., m): the weighted sum of a bag's vectors."""
    rows = att.where(F.col(weight).isNotNull())
    return _batch_vectors(rows, list(group), feat, "m", lambda x, w: w @ x, F.sum, weight).drop("n")


def pool_bags(tiles: DataFrame, dim: int, how: str = "avg", feat: str = "feat", group: Sequence[str] = ("name",),
              p: float = 3.0, eps: float = 1e-6) -> DataFrame:
    """Unweighted pooling per dimension: avg, max, or gem (power mean of values clamped at ``eps``)."""
    group = list(group)
    if how == "max":
        return _batch_vectors(tiles, group, feat, "m", lambda x, w: x.max(0), F.max).drop("n")
    if how == "avg":
        sums, finish = _batch_vectors(tiles, group, feat, "m", lambda x, w: x.sum(0), F.sum), lambda v: v / F.col("n")
    elif how == "gem":
        sums = _batch_vectors(tiles, group, feat, "m", lambda x, w: (np.maximum(x, eps) ** p).sum(0), F.sum)
        finish = lambda v: F.pow(v / F.col("n"), F.lit(1.0 / p))
    else:
        raise ValueError(f"unknown pooling {how}")
    return sums.select(*group, F.transform("m", finish).alias("m"))


def linear_head(bags: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], vector: str = "m") -> DataFrame:
    """Add logit0..: one dot product per class."""
    return bags.withColumns({f"logit{c}": L.dot(F.col(vector), w) + float(b) for c, (w, b) in enumerate(zip(weights, bias))})


def per_class_head(bags: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], vector: str = "m") -> DataFrame:
    """One bag vector per head (cls): class c uses the vector of head c. Returns (name, logit0..)."""
    score = F.lit(None).cast("double")
    for c, (w, b) in enumerate(zip(weights, bias)):
        score = F.when(F.col("cls") == c, L.dot(F.col(vector), w) + float(b)).otherwise(score)
    x = bags.withColumn("__z", score)
    return x.groupBy("name").agg(*[F.max(F.when(F.col("cls") == c, F.col("__z"))).alias(f"logit{c}")
                                   for c in range(len(weights))])


def additive_head(att: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], weight: str = "a_soft",
                  feat: str = "feat") -> tuple[DataFrame, DataFrame]:
    """Per-tile logits of the attention-weighted vectors, and their sums per bag: (tile table, bag table)."""
    cols = {f"logit{c}": L.dot(F.col(feat), w) * F.col(weight) + float(b) for c, (w, b) in enumerate(zip(weights, bias))}
    t = att.withColumns(cols)
    return t, t.groupBy("name").agg(*[F.sum(c).alias(c) for c in cols])


def extreme_instances(att: DataFrame, n: int = 8, value: str = "a_raw", group: Sequence[str] = ("name", "cls")) -> DataFrame:
    """The min(size // 2, n) tiles with the highest and with the lowest attention of every bag, tagged top/bottom."""
    sizes = att.groupBy(*group).agg(F.least(F.floor(F.count(F.lit(1)) / 2), F.lit(n)).alias("__k"))

    def side(largest: bool, tag: str) -> DataFrame:
        best = top_k(att, value, n, group, largest=largest)
        return best.join(sizes, list(group)).where(F.col("rank") <= F.col("__k")).drop("__k").withColumn("side", F.lit(tag))

    return side(True, "top").unionByName(side(False, "bottom"))


def suppress_non_peaks(att: DataFrame, kernel: int = 3, value: str = "a_raw", low: float | Column | None = None,
                       keys: Sequence[str] = ("name", "cls")) -> DataFrame:
    """Peak suppression on the attention grid: a cell that is not the maximum of its kernel window but lies in the
    window of a peak gets the value ``low`` (default: the smallest of its map); repeated until the peaks are stable.

    Each cell sends its value to the kernel^2 cells around it and the receiving cell keeps the best, so the work per
    cell is constant. Every round ends with a reliable checkpoint; one number per round comes to the driver.
    """
    if kernel % 2 == 0:
        raise ValueError("kernel must be odd")
    r, keys = kernel // 2, list(keys)
    base = att.select(*keys, "i", "j", F.col(value).alias("v"))
    floor = base.groupBy(*keys).agg(F.min("v").alias("low"))
    x = base.join(floor, keys)
    if low is not None:
        x = x.withColumn("low", low if isinstance(low, Column) else F.lit(float(low)))
    x = cut_lineage(x.withColumn("peak", F.lit(False)))
    reach = F.explode(F.sequence(F.lit(-r), F.lit(r)))
    while True:
        sent = x.withColumn("di", reach).withColumn("dj", reach)
        best = sent.groupBy(*keys, (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j")).agg(
            F.max(F.struct(F.col("v"), (-F.col("i")).alias("bi"), (-F.col("j")).alias("bj"))).alias("b"))
        now = x.join(best, [*keys, "i", "j"]).withColumn(
            "now", (F.col("b.bi") == -F.col("i")) & (F.col("b.bj") == -F.col("j"))).drop("b")
        near = now.where("now").withColumn("di", reach).withColumn("dj", reach).select(
            *keys, (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j")).distinct()
        now = now.join(near.withColumn("__near", F.lit(True)), [*keys, "i", "j"], "left")
        nxt = cut_lineage(now.select(
            *keys, "i", "j", F.when(F.col("__near") & ~F.col("now"), F.col("low")).otherwise(F.col("v")).alias("v"), "low",
            (F.col("peak") != F.col("now")).alias("changed"), F.col("now").alias("peak")))
        changed = nxt.where("changed").limit(1).count()
        x = nxt.drop("changed")
        if not changed:
            return x.select(*keys, "i", "j", F.col("v").alias(value), "peak")


def score_bags(tiles: DataFrame, attention: dict[str, np.ndarray], head: tuple, dim: int, topk: int | None = None,
               temperature: float | str | None = None) -> DataFrame:
    """(name, logit0..) of all bags of all splits in one plan: attention, background mask, top-k, softmax, weighted
    vectors, linear heads.

    Without top-k and with a fixed temperature the vectors are read once (:func:`pool_with_attention`). With top-k
    only k tiles per bag and task travel on, with their vectors, before softmax and pooling.
    """
    heads = attention["w"].shape[0]
    if topk is None and temperature != "sqrt":
        bags = pool_with_attention(tiles, attention, dim, float(temperature or 1.0)).select("name", "cls", "m")
    else:
        att = mask_background(attention_logits(tiles, attention))
        if topk:
            att = top_k(att.where(F.col("a_raw") > float("-inf")), "a_raw", topk, ["name", "cls"])
        bags = bag_vectors(attention_softmax(att, temperature, few_rows=bool(topk)), dim)
    return linear_head(bags, *head).drop("m", "cls") if heads == 1 else per_class_head(bags, *head)


def fit_bag_classifier(bags: DataFrame, label: str, vector: str = "m", weight: str | None = None, split: str = "split",
                       grid: Sequence[float] = (0.0, 0.01, 0.1)) -> tuple[DataFrame, float]:
    """Logistic regression on pooled bag vectors (Spark ML), the regularisation chosen by validation AUC.

    Returns (all bags with out1 = probability of class 1, chosen regularisation). Attention weights are inputs here,
    not learnt.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from bagframe.operators.binary import roc_auc

    data = bags.withColumn("features", array_to_vector(F.col(vector))).withColumn("label_", F.col(label).cast("double"))
    train = data.where(F.col(split) == "training")
    best = None
    for reg in grid:
        lr = LogisticRegression(featuresCol="features", labelCol="label_", regParam=reg, maxIter=50,
                                probabilityCol="__p", predictionCol="__y", rawPredictionCol="__r")
        if weight:
            lr = lr.setWeightCol(weight)
        scored = lr.fit(train).transform(data).withColumn("out1", vector_to_array("__p")[1]).drop(
            "features", "label_", "__p", "__y", "__r")
        auc = roc_auc(scored.where(F.col(split) == "validation"), label, "out1").first()["auc"]
        if best is None or (auc or 0.0) > best[0]:
            best = (auc or 0.0, reg, scored)
    return best[2], best[1]
