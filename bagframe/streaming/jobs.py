"""Structured Streaming versions of the incremental jobs.

State stays mergeable and bounded: counts, score histograms, last values, and dedup keys within a watermark; no rows
are buffered. Checkpoint locations are below the session's shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from bagframe.functions.stats import ratio


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need TIMESTAMP; zone-less parquet timestamps are cast first."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def once_per_key(df: DataFrame, keys: Sequence[str], *, delay: str, ts: str = "ts") -> DataFrame:
    """One row per key among re-deliveries that arrive within ``delay``. It has no default: later re-deliveries come through and
    rows that are later than that are dropped, so it has to follow from the source."""
    return with_event_time(df, ts, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_confusion(df: DataFrame, target: str, pred: str, keys: Sequence[str], *, delay: str | None, ts: str = "ts",
                       window: str = "1 day") -> DataFrame:
    """tp, fp, fn, tn per (keys, window); every window starts from zero. ``delay=None`` when the input already has a watermark."""
    x = df if delay is None else with_event_time(df, ts, delay)
    t, p = F.col(target) == 1, F.col(pred) == 1
    return x.groupBy(*keys, F.window(ts, window)).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn")).select(*keys, F.col("window.start").alias("start"), "tp", "fp", "fn", "tn")


def windowed_score_histogram(df: DataFrame, target: str, score: str, keys: Sequence[str], *, delay: str | None, bins: int = 100,
                             ts: str = "ts", window: str = "1 day") -> DataFrame:
    """Positives and negatives per (keys, window, score bin over [0, 1]): the bounded state behind a streaming AUC."""
    x = df if delay is None else with_event_time(df, ts, delay)
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return x.groupBy(*keys, F.window(ts, window), b.alias("bin")).agg(
        F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg")).select(
        *keys, F.col("window.start").alias("start"), "bin", "pos", "neg")


def histogram_auc(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., auc, error): AUC from score histograms. Scores inside a bin count as ties, so the AUC is off by at most ``error``, half
    the share of positive-negative pairs that share a bin."""
    from bagframe.operators.scan import ordered_scan

    s = ordered_scan(hist, "bin", list(keys), ["pos", "neg"], descending=True, block_expr=F.lit(0))
    wins = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    pairs = F.max(F.col("total_pos").cast("double") * F.col("total_neg"))
    return s.groupBy(*keys).agg(ratio(F.sum(wins), pairs).alias("auc"), ratio(F.sum(F.col("pos") * F.col("neg") / 2.0), pairs).alias("error"))


def last_per_epoch(df: DataFrame, keys: Sequence[str] = ("run", "epoch", "metric"), *, delay: str | None, ts: str = "ts", window: str = "1 day") -> DataFrame:
    """Last metric value per key and window of event time, kept up to date (update mode). The state of a window goes with the watermark;
    :func:`last_values` picks the last of a key's windows."""
    x = df if delay is None else with_event_time(df, ts, delay)
    return x.groupBy(*keys, F.window(ts, window)).agg(F.max(F.struct("seq", "value")).alias("b")).select(
        *keys, F.col("window.start").alias("start"), F.col("b.seq").alias("seq"), F.col("b.value").alias("value"))


def last_values(sink: DataFrame, keys: Sequence[str] = ("run", "epoch", "metric")) -> DataFrame:
    """(keys..., seq, value) from the sink of :func:`last_per_epoch`."""
    return latest(sink, list(keys), "seq").select(*keys, "value")


def run_available(stream: DataFrame, checkpoint: str, sink: str, mode: str = "append") -> None:
    """Process everything that is there into a parquet table and stop (append mode)."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option(
        "path", sink).trigger(availableNow=True).start()
    _finish(q)


def run_batches(stream: DataFrame, checkpoint: str, sink: str, mode: str = "update") -> None:
    """Write every micro-batch of an update-mode query below ``sink`` in its own folder (overwritten on a retry, so a
    repeated batch does not duplicate rows)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(
        availableNow=True).start()
    _finish(q)


def _finish(q: StreamingQuery) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def latest(df: DataFrame, keys: Sequence[str], version: str = "batch") -> DataFrame:
    """The newest row per key of an update-mode sink. The map side keeps one row per key; :func:`compact` keeps the sink itself short."""
    rest = [c for c in df.columns if c not in keys and c != version]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r")).select(*keys, "r.*")


def compact(spark: SparkSession, sink: str, target: str, keys: Sequence[str]) -> None:
    """Write the newest row per key of an update-mode sink as batch 0 of a new sink, which further runs continue."""
    newest = latest(spark.read.option("basePath", sink).parquet(sink), keys)
    newest.write.mode("overwrite").parquet(f"{target}/batch=0")


#: Batches whose keys are put together into one table, and so on with the tables; parts of such a table by the hash of the key.
MERGED = 8
PARTS = 256


def _segments(n: int) -> list[tuple[int, int]]:
    """(first batch, batches) of the tables that cover the batches before n: sizes are powers of MERGED, the largest first."""
    out, first, size = [], 0, 1
    while size * MERGED <= n:
        size *= MERGED
    while first < n:
        while first + size > n:
            size //= MERGED
        out.append((first, size))
        first += size
    return out


def _part(key: str):
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _succeeded(spark: SparkSession, out: str, key: str, segments: Sequence[tuple[int, int]], parts: Sequence[int] | None = None) -> DataFrame | None:
    """(key, part) of the successes of these batches; with `parts` only of these."""
    found = None
    for first, size in segments:
        if size == 1:
            keys = spark.read.parquet(f"{out}/batch={first}").select(key).withColumn("part", _part(key))
        else:
            keys = spark.read.parquet(f"{out}-keys/{first}-{size}").select(key, "part")
        if parts is not None:
            keys = keys.where(F.col("part").isin(list(parts)))
        found = keys if found is None else found.unionByName(keys)
    return found


def _merge_successes(spark: SparkSession, out: str, key: str, n: int) -> None:
    """Tables that end at batch n, each from MERGED of the next smaller ones. A repeated call writes the same again."""
    size = MERGED
    while n and n % size == 0:
        small = size // MERGED
        keys = _succeeded(spark, out, key, [(n - size + i * small, small) for i in range(MERGED)])
        keys.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{out}-keys/{n - size}-{size}")
        size *= MERGED


def ingest_new(stream: DataFrame, process: Callable[[DataFrame], DataFrame], key: str, out: str, report: str, checkpoint: str) -> None:
    """Process each arriving item until it succeeds, and then no more: a batch leaves out the keys that earlier batches had success with,
    however late a delivery is, so a failure that is delivered again is tried again. Of several deliveries in one batch one is taken.
    ``process`` returns rows with ``ok`` and ``error``; successes go to ``out``, every attempt to ``report``.

    Keys of successes are kept below ``{out}-keys``, in tables that grow with the powers of MERGED and are partitioned by the key's hash: a batch
    reads a few tables, and of the merged ones only the parts that its own keys fall into. A null key is a key. All tables are written per
    batch number with overwrite, which makes a repeated batch idempotent.
    """
    spark = stream.sparkSession
    out = out.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key])
        _merge_successes(spark, out, key, number)
        if number:
            parts = [r["part"] for r in fresh.select(_part(key).alias("part")).distinct().collect()]       # PARTS numbers at most
            done = _succeeded(spark, out, key, _segments(number), parts).select(F.col(key).alias("done_key"), F.col("part").alias("done_part"))
            fresh = fresh.join(done, (_part(key) == F.col("done_part")) & F.col(key).eqNullSafe(F.col("done_key")), "left_anti")
        result = process(fresh)
        result.select(key, "ok", "error").write.mode("overwrite").parquet(f"{report}/batch={number}")
        result.where("ok").drop("ok", "error").write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    _finish(q)
