"""Hot keys are spread: with broadcast joins off and 90 % of the rows in one key, no task gets much more than its share."""

from pyspark.sql import functions as F

from bagframe.operators import bags as BG
from bagframe.operators import profile as PR
from bagframe.operators.hot import attach_table, keep_keys, with_stats

PARTS = 16


def _rows(spark):
    hot = F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string")))
    return spark.range(0, 40_000, 1, 8).select(hot.alias("name"), F.lit(0).alias("cls"), F.col("id").alias("i"), (F.col("id") % 7).alias("j"),
                                               (F.col("id") % 13).cast("double").alias("a_raw"))


def _even(spark, make):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sizes = [r["n"] for r in make().groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert max(sizes) <= 2 * sum(sizes) / PARTS, sizes


def test_hot_keys_are_spread(spark):
    rows = _rows(spark)
    _even(spark, lambda: with_stats(rows, ["name"], top=F.max("a_raw")))
    _even(spark, lambda: BG.attention_softmax(rows))
    _even(spark, lambda: PR.duplicates(rows, "name"))


def test_statistics_are_right(spark):
    rows = _rows(spark).limit(1000).unionByName(spark.createDataFrame([(None, 0, 1, 1, 5.0)], "name string, cls int, i long, j long, a_raw double"))
    got = with_stats(rows, ["name"], "left", top=F.max("a_raw"), n=F.count(F.lit(1)))
    want = {r["name"]: (r["top"], r["n"]) for r in rows.groupBy("name").agg(F.max("a_raw").alias("top"), F.count(F.lit(1)).alias("n")).collect()}
    out = got.collect()
    assert len(out) == rows.count() and all((r["top"], r["n"]) == (want[r["name"]] if r["name"] else (None, None)) for r in out)
    table = spark.createDataFrame([("hot", 1), ("k3", 2), ("nowhere", 3)], "name string, v int")
    assert {(r["name"], r["v"]) for r in attach_table(rows, table, ["name"]).collect()} == {("hot", 1), ("k3", 2)} & {(n, v) for n, v in (("hot", 1), ("k3", 2)) if n in want}
    kept, rest = keep_keys(rows, table.select("name"), ["name"]), keep_keys(rows, table.select("name"), ["name"], anti=True)
    assert kept.count() + rest.count() == rows.count() and rest.where("name is null").count() == 1
    assert {r["name"] for r in kept.collect()} <= {"hot", "k3"} and not {r["name"] for r in rest.collect()} & {"hot", "k3"}
