"""Queries on readers, writers and streams: tables are written to the session's shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagframe.operators import binary as B
from bagframe.operators import joins as J
from bagframe.operators import multiclass as M
from bagframe.operators.spec import CohortSpec, TrainType
from bagframe.plans import fixtures as fx
from bagframe.plans.queries_bags import ATT, BG_TILES, attention, bg_tiles
from bagframe.plans.registry import query
from bagframe.session import scratch_path
from bagframe.sources import bags as SB
from bagframe.sources import cohorts as SC
from bagframe.sources import inventory as IN
from bagframe.streaming import jobs as ST

BINARY = CohortSpec(TrainType.CLF, ("Neg", "Pos"))
MULTI = CohortSpec(TrainType.MULTILABEL, ("other", "quality", "toxic"))


# ---------------------------------------------------------------- cohort files

@query("cohort_csv_round_trip", "name:s split:s category:s Neg:l Pos:l", "select name, split, category, Neg, Pos from cohort", "cohort")
def _(spark, sf):
    """Written sorted by name with chosen columns, read back with names as text."""
    path = scratch_path(spark, "cohort")
    SC.write_cohort(fx.cohort(spark, sf), path, BINARY, ["name", "split", "category", "Neg", "Pos"])
    return SC.read_cohort_csv(spark, path, BINARY)


@query("cohort_csv_default_split", "name:s split:s Pos:l", "select name, 'default' as split, Pos from cohort", "cohort")
def _(spark, sf):
    """A file without split column."""
    path = scratch_path(spark, "cohort")
    SC.write_cohort(fx.cohort(spark, sf), path + "/t.csv", BINARY, ["name", "Neg", "Pos"])
    return SC.read_cohort(spark, path + "/t.csv", BINARY)


@query("cohort_yaml", "name:s split:s category:s image:s mask:s other:l quality:l toxic:l",
       """select 'n' || name as name, split, category, '/data/img/n' || name || '.tif' as image, case when doc_id % 3 = 0 then '/data/mask/n' || name || '.tif' end as mask, other, quality, toxic
          from cohort_ml""", "cohort_ml")
def _(spark, sf):
    """Nested cohort files (one per 100 ids) with path placeholders, short split names and label lists."""
    c = fx.cohort_ml(spark, sf)
    labels = F.array_compact(F.array(*[F.when(F.col(t) == 1, F.lit(k)) for k, t in enumerate(MULTI.target_cols)]))
    item = F.to_json(F.struct(F.concat(F.lit("{img}/n"), "name", F.lit(".tif")).alias("image"),
                              F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("{mask}/n"), "name", F.lit(".tif"))).alias("mask"),
                              labels.alias("labels")))
    short = F.when(F.col("split") == "training", "train").when(F.col("split") == "validation", "val").otherwise("test")
    part = F.floor(F.col("doc_id") / 100)
    cats = c.select(part.alias("part"), short.alias("s"), "category", item.alias("item")).groupBy("part", "s", "category").agg(
        F.concat(F.lit('"'), F.first("category"), F.lit('": ['), F.array_join(F.collect_list("item"), ", "), F.lit("]")).alias("c"))
    splits = cats.groupBy("part", "s").agg(F.concat(F.lit('"'), F.first("s"), F.lit('": {'), F.array_join(F.collect_list("c"), ", "), F.lit("}")).alias("c"))
    docs = splits.groupBy("part").agg(F.concat(F.lit('{"path": {"img": "/data/img", "mask": "/data/mask"}, "data": {'),
                                               F.array_join(F.collect_list("c"), ", "), F.lit("}}")).alias("value"))
    path = scratch_path(spark, "yaml") + "/cohorts.yaml"
    docs.write.partitionBy("part").text(path)
    return SC.read_cohort(spark, path, MULTI)


@query("table_csv_stripped_columns", "o_orderkey:l o_totalprice:d", "select o_orderkey, o_totalprice from orders")
def _(spark, sf):
    """Column names with surrounding spaces."""
    path = scratch_path(spark, "csv")
    df = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias(" o_orderkey "), F.col("o_totalprice").alias("o_totalprice "))
    SC.save_table(df, path, fmt="csv")
    return SC.read_table_csv(spark, path, "o_orderkey long, ` o_totalprice` double")


@query("split_exchange_files", "split:s slide:s label:l", "select split, name as slide, Pos as label from cohort", "cohort")
def _(spark, sf):
    """Per-split two-column files, written and read back."""
    path = scratch_path(spark, "splits")
    SC.write_split_files(fx.cohort(spark, sf), path, BINARY)
    return spark.read.option("header", True).schema("slide string, label int, split string").csv(path)


@query("cohort_from_split_files", "name:s split:s image:s Neg:l Pos:l label:l",
       "select name, split, '/img/' || name || '.tif' as image, Neg, Pos, Pos as label from cohort", "cohort")
def _(spark, sf):
    """Three per-split tables with train/val/test name columns to one cohort."""
    c = fx.cohort(spark, sf)

    def part(split, col):
        return c.where(F.col("split") == split).select(F.concat("name", F.lit(".tif")).alias(col), F.col("Pos").alias("label"))

    return SC.from_split_files({"training": part("training", "train"), "validation": part("validation", "val"),
                                "testing": part("testing", "test")}, ["Neg", "Pos"], image_dir="/img")


@query("save_refuses_to_overwrite", "kept:l", "select count(*) as kept from cohort where split = 'training'", "cohort")
def _(spark, sf):
    """A second save without permission fails and leaves the table as it was."""
    from pyspark.errors import AnalysisException

    path = scratch_path(spark, "table")
    c = fx.cohort(spark, sf)
    SC.save_table(c.where("split = 'training'"), path)
    try:
        SC.save_table(c, path)
    except AnalysisException:
        pass
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("kept"))


@query("metrics_json", "split:s metric:s value:d",
       "select split, 'n' as metric, count(*) as value from preds group by split union all select split, 'n_pos', sum(Pos) from preds group by split", "preds")
def _(spark, sf):
    """Metrics as one JSON document per split, read back."""
    path = scratch_path(spark, "json")
    rep = B.roc_auc(fx.preds(spark, sf), "Pos", "out1", ["split"]).select("split", "n", "n_pos")
    SC.save_metrics_json(M.to_long_metrics(rep, ["split"]), path, ["split"])
    return spark.read.schema("split string, metrics map<string,double>").json(path).select("split", F.explode("metrics").alias("metric", "value"))


@query("predictions_written", "split:s name:s out1:d", "select split, name, out1 from preds", "preds")
def _(spark, sf):
    """Prediction table stored by split and read back."""
    path = scratch_path(spark, "predictions")
    SC.save_table(fx.preds(spark, sf), path, partition_by=["split"])
    return spark.read.parquet(path).select("split", "name", "out1")


# ---------------------------------------------------------------- inventories

@query("file_inventory", "folder:s suffix:s n:l", "select lower(replace(r_name, ' ', '_')) as folder, '.csv' as suffix, 1 as n from region")
def _(spark, sf):
    """Several folders, one per region, as one inventory: names must be unique, contents are not read."""
    path = scratch_path(spark, "inventory")
    nations = fx.table(spark, sf, "nation").join(fx.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    folders = [f"{path}/{r.lower().replace(' ', '_')}" for (r,) in nations.select("r_name").distinct().collect()]      # a folder each
    for folder in folders:
        own = F.lower(F.replace(F.col("r_name"), F.lit(" "), F.lit("_"))) == folder.rsplit("/", 1)[1]
        IN.write_infos(nations.where(own).select("n_name").coalesce(1), folder)
    inv = IN.unique_names(IN.list_files(spark, ",".join(folders), "*.csv"))
    return inv.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder"), "suffix").agg(F.count(F.lit(1)).alias("n"))


@query("file_inventory_from_cache", "name:s suffix:s path:s", "select name, '.tif' as suffix, '{}/' || name || '.tif' as path from cohort".replace("{}", "/store"), "cohort")
def _(spark, sf):
    """An infos CSV next to the files replaces the listing; its names still carry the suffix."""
    path = scratch_path(spark, "infos")
    IN.write_infos(fx.cohort(spark, sf).select(F.concat("name", F.lit(".tif")).alias("name"), F.lit("x").alias("path")), path + "/infos.csv")
    inv = IN.cached_inventory(spark, path, "infos.csv")
    return inv.withColumn("path", F.concat(F.lit("/store"), F.substr("path", F.lit(len(path) + 1))))


@query("infos_without_path", "columns:s n:l", "select 'name,code_size' as columns, count(*) as n from cohort", "cohort")
def _(spark, sf):
    """Infos are stored without the path column."""
    path = scratch_path(spark, "infos")
    IN.write_infos(fx.cohort(spark, sf).select("name", F.lit("/x").alias("path"), F.lit(64).alias("code_size")), path)
    back = spark.read.csv(path, header=True)
    return back.agg(F.lit(",".join(back.columns)).alias("columns"), F.count(F.lit(1)).alias("n"))


@query("paths_filtered", "url:s",
       """select url from pages where (contains(n, '1') or contains(n, '2')) and not contains(n, 'page=2') and not starts_with(n, '.')
            and (ends_with(n, '1') or ends_with(n, '3') or ends_with(n, 'x'))""".replace("pages where", "(select url, regexp_extract(url, '([^/]*)$', 1) as n from pages) where"))
def _(spark, sf):
    """Paths by parts of the file name, exclusions and endings."""
    return IN.filter_paths(fx.table(spark, sf, "pages"), "url", containing_any="1,2", not_containing=["page=2"], endings=["1", "3", "x"])


@query("paths_filtered_any_case", "url:s",
       """select url from pages where contains(lower(url), 'example.com') and contains(lower(url), '/de/') and not contains(lower(url), 'page=3')
            and len(string_split(substr(url, 8), '/')) <= 3""")
def _(spark, sf):
    """The whole path in any case, with a depth limit."""
    return IN.filter_paths(fx.table(spark, sf, "pages"), "url", containing_all=["EXAMPLE.com", "/DE/"], not_containing="PAGE=3",
                           ignore_case=True, depth=3, root="http://")


@query("name_path_table", "name:s path:s", "select regexp_replace(path, '^.*/|\\.tif$', '', 'g') as name, path from paths", "paths")
def _(spark, sf):
    return IN.name_path_table(fx.paths(spark, sf))


@query("rows_with_existing_files", "name:s", "select name from cohort where '/img/p' || lpad(name, 9, '0') || '.tif' in (select path from paths)", ("cohort", "paths"))
def _(spark, sf):
    """Rows whose image is in the inventory."""
    c = fx.cohort(spark, sf).withColumn("image", F.concat(F.lit("/img/p"), F.lpad("name", 9, "0"), F.lit(".tif")))
    return IN.with_existing_files(c, fx.paths(spark, sf))


# ---------------------------------------------------------------- bags and attention

@query("bag_store_round_trip", "name:s n:l code_size:l stride:l tiles:l sum_all:d",
       "select name, count(*) as n, 64 as code_size, 256 as stride, count(*) as tiles, sum(list_sum(list_transform(feat, lambda v: cast(v as double)))) as sum_all from bg where feat is not null group by name",
       "tiles", bg=BG_TILES)
def _(spark, sf):
    """Bags written without background, read back with their infos."""
    path = scratch_path(spark, "bags")
    SB.write_bags(bg_tiles(spark, sf), path, 256, 0.5, 256)
    t = SB.tiles_with_info(spark, path)
    whole = F.aggregate("feat", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return t.groupBy("name", "n", "code_size", "stride").agg(F.count(F.lit(1)).alias("tiles"), F.sum(whole).alias("sum_all"))


@query("bags_verified", "name:s side:s", "select distinct name, 'store' as side from tiles where name in ('b3', 'b7')", "tiles")
def _(spark, sf):
    """Names that are only in the cohort or only in the store."""
    t = fx.tiles(spark, sf).select("name").distinct()
    return SB.verify_bags(t.where(~F.col("name").isin("b3", "b7")), t)


@query("code_size_common", "n:l code_size:l", "select count(distinct vec_id % 25) as n, 64 as code_size from embeddings")
def _(spark, sf):
    """The one vector width of all bags."""
    from bagframe.operators.tiles import bag_info

    info = bag_info(fx.tiles(spark, sf), 256)
    SB.common_code_size(info)                                  # an error if there are two
    return info.agg(F.count(F.lit(1)).alias("n"), F.max("code_size").alias("code_size"))


@query("attention_stored", "name:s cls:l total:d", "select name, cls, sum(a_raw) as total from att group by all", "tiles", att=ATT)
def _(spark, sf):
    """Attention cells appended to a table and read back."""
    path = scratch_path(spark, "attention")
    a = attention(spark, sf)
    SB.save_attention(a.where("cls = 0"), path)
    SB.save_attention(a.where("cls = 1"), path)
    return spark.read.parquet(path).groupBy("name", "cls").agg(F.sum("a_raw").alias("total"))


# ---------------------------------------------------------------- streams

def _event_files(spark, sf, duplicates: bool = True):
    """Events as a folder of small files; every 20th event is delivered twice."""
    path = scratch_path(spark, "events")
    e = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    if duplicates:
        e = e.unionByName(e.where("event_id % 20 = 0"))
    e.repartitionByRange(8, "ts").write.parquet(path)
    return path, e.schema


def _predicted(df):
    return df.withColumns({"model": F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")),
                           "target": (F.col("event_type") == "click").cast("int"),
                           "score": (F.col("event_id") * 37 % 101 + F.col("user_id")) / 260.0 + F.when(F.col("event_type") == "click", 0.1).otherwise(0.0)})


EV = """select 'm' || cast(user_id % 3 as varchar) as model, date_trunc('day', ts) as start, cast(event_type = 'click' as integer) as target,
    (event_id * 37 % 101 + user_id) / 260.0e0 + case when event_type = 'click' then 0.1e0 else 0 end as score from events"""


@query("stream_once_per_key", "event_id:l user_id:l value:d", "select event_id, user_id, value from events")
def _(spark, sf):
    """Re-delivered events kept once, within a watermark."""
    path, schema = _event_files(spark, sf)
    out, ck = scratch_path(spark, "once"), scratch_path(spark, "ck")
    ST.run_available(ST.once_per_key(ST.file_stream(spark, path, schema, 4), ["event_id"], delay="60 days"), ck, out)
    return spark.read.parquet(out)


@query("stream_windowed_confusion", "model:s start:s tp:l fp:l fn:l tn:l",
       """select model, cast(cast(start as date) as varchar) as start, count(*) filter (target = 1 and score >= 0.3) as tp, count(*) filter (target = 0 and score >= 0.3) as fp,
            count(*) filter (target = 1 and score < 0.3) as fn, count(*) filter (target = 0 and score < 0.3) as tn from ev group by model, start""", ev=EV)
def _(spark, sf):
    """Confusion counts per model and day, kept up to date."""
    path, schema = _event_files(spark, sf, False)
    out, ck = scratch_path(spark, "conf"), scratch_path(spark, "ck")
    s = _predicted(ST.file_stream(spark, path, schema, 4)).withColumn("pred", B.threshold_scores("score", 0.3))
    ST.run_batches(ST.windowed_confusion(s, "target", "pred", ["model"], delay="60 days"), ck, out)
    return ST.latest(spark.read.parquet(out), ["model", "start"]).withColumn("start", F.col("start").cast("date"))


@query("stream_histogram_auc", "model:s auc:d error:d exact:d within:b",
       """select model, auc, error, exact, abs(auc - exact) <= error + 1e-12 as within from (select model, sum(neg * (above + pos / 2.0e0)) / (max(p) * cast(max(n) as double)) as auc,
              sum(pos * neg / 2.0e0) / (max(p) * cast(max(n) as double)) as error from (select *, coalesce(sum(pos) over (partition by model order by bin desc rows between unbounded preceding and 1 preceding), 0) as above,
              sum(pos) over (partition by model) as p, sum(neg) over (partition by model) as n
            from (select model, least(floor(score * 50), 49) as bin, count(*) filter (target = 1) as pos, count(*) filter (target = 0) as neg from ev group by all)) group by model)
          join (select model, (sum(case when target = 1 then r end) - max(p) * (max(p) + 1) / 2.0e0) / (max(p) * cast(count(*) - max(p) as double)) as exact from (
              select model, target, rank() over (partition by model order by score) + (count(*) over (partition by model, score) - 1) / 2.0e0 as r,
                sum(target) over (partition by model) as p from ev) group by model) using (model)""", ev=EV)
def _(spark, sf):
    """AUC from streamed score histograms, its error bound, and the exact AUC of the same events."""
    path, schema = _event_files(spark, sf, False)
    out, ck = scratch_path(spark, "hist"), scratch_path(spark, "ck")
    s = _predicted(ST.file_stream(spark, path, schema, 4))
    ST.run_batches(ST.windowed_score_histogram(s, "target", "score", ["model"], bins=50, delay="60 days"), ck, out)
    h = ST.latest(spark.read.parquet(out), ["model", "start", "bin"])
    binned = ST.histogram_auc(h.groupBy("model", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), ["model"])
    exact = B.roc_auc(_predicted(spark.read.schema(schema).parquet(path)), "target", "score", ["model"]).select("model", F.col("auc").alias("exact"))
    return binned.join(exact, "model").withColumn("within", F.abs(F.col("auc") - F.col("exact")) <= F.col("error") + 1e-12)


@query("stream_last_per_epoch", "run:s epoch:l metric:s value:d",
       "select run, epoch, metric, max_by(value, seq) as value from history group by all", "history")
def _(spark, sf):
    """Last metric value per epoch from an event feed."""
    path, schema = _event_files(spark, sf)
    out, ck = scratch_path(spark, "last"), scratch_path(spark, "ck")
    s = ST.file_stream(spark, path, schema, 4).select(
        F.concat(F.lit("run"), (F.col("user_id") % 5).cast("string")).alias("run"), F.dayofmonth("ts").alias("epoch"),
        F.col("event_id").alias("seq"), F.col("event_type").alias("metric"), "value", "ts")
    ST.run_batches(ST.last_per_epoch(s, delay="60 days"), ck, out)
    compacted = scratch_path(spark, "last")
    ST.compact(spark, out, compacted, ["run", "epoch", "metric", "start"])
    return ST.last_values(spark.read.parquet(compacted))


@query("stream_ingest_once", "part:s event_id:l",
       """select 'done' as part, event_id from events where event_id % 13 <> 0 union all select 'failed', event_id from events where event_id % 13 = 0""")
def _(spark, sf):
    """Items processed once each; failures are reported and can be retried."""
    path, schema = _event_files(spark, sf)
    base = scratch_path(spark, "ingest")

    def work(batch):
        bad = F.col("event_id") % 13 == 0
        return batch.withColumns({"ok": ~bad, "error": F.when(bad, "unreadable")})

    ST.ingest_new(ST.file_stream(spark, path, schema, 4), work, "event_id", base + "/out", base + "/report", base + "/ck")
    out, rep = spark.read.parquet(base + "/out"), spark.read.parquet(base + "/report")
    failed = J.not_done(rep.where("not ok").select("event_id").distinct(), out, "event_id")
    return out.select(F.lit("done").alias("part"), "event_id").unionByName(failed.select(F.lit("failed").alias("part"), "event_id"))


