from collections import Counter

from pyspark.sql import functions as F

from bagframe.session import scratch_path
from bagframe.streaming import jobs as ST


def test_ingest_retries_failures_and_takes_late_deliveries(spark):
    """One file a batch; item 1 fails first and is delivered again, item 7 is first delivered long after its event time."""
    base = scratch_path(spark, "ingest-test")
    batches = [[(1, False, "2024-03-01"), (2, True, "2024-03-01"), (None, True, "2024-03-01")], [(1, True, "2024-03-01"), (2, True, "2024-03-01")],
               [(3, True, "2024-03-09"), (None, True, "2024-03-09")], [(4, True, "2024-03-09")], [(7, True, "2020-01-01"), (1, True, "2024-03-09")]]
    batches += [[(10 + k, True, "2024-03-09"), (k, True, "2024-03-09")] for k in range(1, 14)]

    def work(batch):
        return batch.withColumns({"ok": F.col("good"), "error": F.when(~F.col("good"), "unreadable")})

    schema = spark.createDataFrame([], "id long, good boolean, ts timestamp").schema
    for rows in batches:
        spark.createDataFrame(rows, "id long, good boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(base + "/in")
        ST.ingest_new(ST.file_stream(spark, base + "/in", schema), work, "id", base + "/out", base + "/report", base + "/ck")
    got = [r.id for r in spark.read.parquet(base + "/out").collect()]
    assert Counter(got) == Counter({i for rows in batches for i, _, _ in rows})
    report = Counter((r.id, r.ok) for r in spark.read.parquet(base + "/report").collect())
    assert report == Counter([(i, True) for i in got] + [(1, False)])
    assert spark.read.parquet(base + "/out-keys/0-8").count() == spark.read.parquet(base + "/out").where("batch < 8").count()


def test_segments_cover_all_batches():
    for n in range(200):
        covered = [b for first, size in ST._segments(n) for b in range(first, first + size)]
        assert covered == list(range(n)) and len(ST._segments(n)) <= 3 * (ST.MERGED - 1)
