"""Tables of the library's shapes, derived by Spark from the driver tables, and the same tables as SQL views.

``SQL`` holds one portable definition per view; the Spark side runs it through ``spark.sql`` or the DataFrame
functions below, the oracle side puts it in front of its query as a CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    """Binary cohort with two category levels: labels joined to documents."""
    lab, doc = table(spark, sf, "labels"), table(spark, sf, "documents")
    m = F.col("doc_id") % 10
    return lab.join(doc.select("doc_id", "lang", "source", "n_chars"), "doc_id").select(
        F.col("doc_id").cast("string").alias("name"),
        F.when(m < 6, "training").when(m < 8, "validation").otherwise("testing").alias("split"),
        F.col("lang").alias("category"), F.col("source").alias("category2"),
        (1 - F.col("quality")).cast("int").alias("Neg"), F.col("quality").cast("int").alias("Pos"),
        F.col("toxic"), F.col("n_chars"), F.col("doc_id"),
    )


def cohort_ml(spark: SparkSession, sf: str) -> DataFrame:
    """Multilabel cohort with the classes other, quality, toxic (severity order)."""
    return cohort(spark, sf).select(
        "name", "split", "category", "category2",
        F.when((F.col("Pos") == 0) & (F.col("toxic") == 0), 1).otherwise(0).cast("int").alias("other"),
        F.col("Pos").alias("quality"), F.col("toxic").cast("int").alias("toxic"), "n_chars", "doc_id",
    )


def _score(member: int = 0):
    doc, pos = F.col("doc_id") + member, F.col("Pos")
    base = ((F.col("doc_id") + member) * 7919 + F.col("n_chars") * 31) % 700
    return (base + 300 * pos * F.when(doc % 3 > 0, 1).otherwise(0)).cast("double") / 1000.0


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Binary prediction table with heavy score ties."""
    c = cohort(spark, sf)
    return c.withColumn("out1", _score()).select(
        "name", "split", "category", "category2", "Neg", "Pos", (F.lit(1.0) - F.col("out1")).alias("out0"), "out1")


def ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Five prediction tables of the same names, one row per (member, name)."""
    c = cohort(spark, sf)
    members = [c.withColumn("out1", _score(m)).select(
        F.lit(m).cast("int").alias("member"), "name", "split", "category", "Neg", "Pos",
        F.concat(F.lit("/m"), F.lit(str(m)), F.lit("/"), F.col("name")).alias("path"),
        (F.lit(1.0) - F.col("out1")).alias("out0"), "out1") for m in range(5)]
    out = members[0]
    for m in members[1:]:
        out = out.unionByName(m)
    return out


def preds3(spark: SparkSession, sf: str) -> DataFrame:
    """Three class predictions: label modulo 3, logits are the first three vector entries."""
    e = table(spark, sf, "embeddings")
    z = [F.col("embedding")[k].cast("double") for k in range(3)]
    e = e.select(F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("name"),
                 F.when(F.col("vec_id") % 2 == 0, "validation").otherwise("testing").alias("split"),
                 (F.col("label") % 3).cast("int").alias("y"), *[z[k].alias(f"logit{k}") for k in range(3)])
    total = F.exp("logit0") + F.exp("logit1") + F.exp("logit2")
    return e.select("name", "split", "y", *[(F.col("y") == k).cast("int").alias(f"c{k}") for k in range(3)],
                    "logit0", "logit1", "logit2", *[(F.exp(f"logit{k}") / total).alias(f"out{k}") for k in range(3)])


def preds_ml(spark: SparkSession, sf: str) -> DataFrame:
    """Multilabel predictions for the cohort_ml classes, one arithmetic score per class."""
    c = cohort_ml(spark, sf)
    cols = []
    for k, cls in enumerate(("other", "quality", "toxic")):
        base = (F.col("doc_id") * (7919 + 104 * k) + F.col("n_chars") * (31 + 6 * k)) % 600
        cols.append(((base + 400 * F.col(cls)).cast("double") / 1000.0).alias(f"out{k}"))
    return c.select("name", "split", "category", "category2", "other", "quality", "toxic", *cols)


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """25 bags of tiles on a 5-column grid with 64-wide vectors; tiles with little tissue become background."""
    e = table(spark, sf, "embeddings")
    q = F.floor(F.col("vec_id") / 25.0)
    return e.select(
        F.concat(F.lit("b"), (F.col("vec_id") % 25).cast("string")).alias("name"),
        F.floor(q / 5.0).cast("long").alias("i"), (q.cast("long") % 5).alias("j"),
        (((F.col("vec_id") * 37) % 100).cast("double") / 100.0).alias("tissue_frac"),
        (F.col("label") % 3).alias("cls"), F.col("embedding").alias("feat"), F.col("vec_id"))


def surv(spark: SparkSession, sf: str) -> DataFrame:
    """Survival cohort: months between a customer's first and last order, event when the last one is 'F'."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    last = F.struct(day.alias("day"), F.col("o_orderkey"), F.col("o_orderstatus").alias("status"))
    o = o.groupBy("o_custkey").agg(F.min(day).alias("first"), F.max(last).alias("last"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_custkey").cast("string").alias("name"), F.col("c_mktsegment").alias("grp"),
        F.col("c_acctbal").alias("marker"), F.col("c_nationkey").cast("double").alias("nation"),
        F.floor((F.col("last.day") - F.col("first")) / 30.0).cast("double").alias("duration"),
        (F.col("last.status") == "F").cast("int").alias("event"), F.col("c_custkey").alias("id"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Training event log: one row per logged metric value."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("run"), (F.col("user_id") % 5).cast("string")).alias("run"),
        F.dayofmonth("ts").cast("int").alias("epoch"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("metric"), "value")


def report(spark: SparkSession, sf: str) -> DataFrame:
    """Run report of a bulk job: status flags per item."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("name"), (F.col("o_orderstatus") == "F").alias("ok"),
        (F.col("o_orderstatus") == "O").alias("existed"),
        F.when(F.col("o_orderstatus") == "P", "failed").alias("error"))


def masks(spark: SparkSession, sf: str) -> DataFrame:
    """4 x 4 mask cells per tile with values 0..2."""
    t = tiles(spark, sf).select("name", "i", "j", "vec_id")
    t = t.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(3))))
    t = t.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(3))))
    v = (F.col("vec_id") * (F.col("r") + 1) * (F.col("c") + 3)) % 3
    return t.select("name", (F.col("i") * 4 + F.col("r")).alias("mi"), (F.col("j") * 4 + F.col("c")).alias("mj"),
                    v.cast("int").alias("v"))


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """Image paths: one file per page with a zero-padded number, so no stem is a prefix of another."""
    p = table(spark, sf, "pages")
    return p.select(F.concat(F.lit("/img/p"), F.lpad(F.col("page_id").cast("string"), 9, "0"),
                             F.lit(".tif")).alias("path"), "page_id")


def side_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Mask paths: most images have one file with a longer stem, some two, every 7th none."""
    p = table(spark, sf, "pages").where(F.col("page_id") % 7 != 0)
    stem = F.concat(F.lit("/mask/p"), F.lpad(F.col("page_id").cast("string"), 9, "0"))
    one = p.select(F.concat(stem, F.lit("_tissue.tif")).alias("path"))
    two = p.where(F.col("page_id") % 5 == 0).select(F.concat(stem, F.lit("_mask2.tif")).alias("path"))
    extra = p.where(F.col("page_id") % 11 == 0).select(
        F.concat(F.lit("/mask/x"), F.col("page_id").cast("string"), F.lit("_tissue.tif")).alias("path"))
    return one.unionByName(two).unionByName(extra)


SQL = {
    "cohort": """
      select cast(l.doc_id as varchar) as name,
        case when l.doc_id % 10 < 6 then 'training' when l.doc_id % 10 < 8 then 'validation' else 'testing' end as split,
        d.lang as category, d.source as category2, cast(1 - l.quality as integer) as Neg,
        cast(l.quality as integer) as Pos, l.toxic as toxic, d.n_chars as n_chars, l.doc_id as doc_id
      from labels l join documents d on l.doc_id = d.doc_id""",
    "cohort_ml": """
      select name, split, category, category2,
        cast(case when Pos = 0 and toxic = 0 then 1 else 0 end as integer) as other, Pos as quality,
        cast(toxic as integer) as toxic, n_chars, doc_id from cohort""",
    "preds": """
      select name, split, category, category2, Neg, Pos, 1.0e0 - out1 as out0, out1 from (select *,
        cast(((doc_id * 7919 + n_chars * 31) % 700) + 300 * Pos * (case when doc_id % 3 > 0 then 1 else 0 end)
          as double) / 1000.0e0 as out1 from cohort)""",
    "ensemble": """
      select member, name, split, category, Neg, Pos, '/m' || cast(member as varchar) || '/' || name as path,
        1.0e0 - out1 as out0, out1 from (select *,
        cast((((doc_id + member) * 7919 + n_chars * 31) % 700)
          + 300 * Pos * (case when (doc_id + member) % 3 > 0 then 1 else 0 end) as double) / 1000.0e0 as out1
        from cohort, (select cast(unnest([0,1,2,3,4]) as integer) as member))""",
    "preds3": """
      select name, split, y, cast(y = 0 as integer) as c0, cast(y = 1 as integer) as c1, cast(y = 2 as integer) as c2,
        logit0, logit1, logit2,
        exp(logit0) / (exp(logit0) + exp(logit1) + exp(logit2)) as out0,
        exp(logit1) / (exp(logit0) + exp(logit1) + exp(logit2)) as out1,
        exp(logit2) / (exp(logit0) + exp(logit1) + exp(logit2)) as out2
      from (select 's' || cast(vec_id as varchar) as name,
        case when vec_id % 2 = 0 then 'validation' else 'testing' end as split, cast(label % 3 as integer) as y,
        cast(embedding[1] as double) as logit0, cast(embedding[2] as double) as logit1,
        cast(embedding[3] as double) as logit2 from embeddings)""",
    "preds_ml": """
      select name, split, category, category2, other, quality, toxic,
        cast((doc_id * 7919 + n_chars * 31) % 600 + 400 * other as double) / 1000.0e0 as out0,
        cast((doc_id * 8023 + n_chars * 37) % 600 + 400 * quality as double) / 1000.0e0 as out1,
        cast((doc_id * 8127 + n_chars * 43) % 600 + 400 * toxic as double) / 1000.0e0 as out2 from cohort_ml""",
    "tiles": """
      select 'b' || cast(vec_id % 25 as varchar) as name,
        cast(floor(floor(vec_id / 25.0e0) / 5.0e0) as bigint) as i, cast(floor(vec_id / 25.0e0) as bigint) % 5 as j,
        cast((vec_id * 37) % 100 as double) / 100.0e0 as tissue_frac, label % 3 as cls, embedding as feat, vec_id
      from embeddings""",
    "surv": """
      select cast(c_custkey as varchar) as name, c_mktsegment as grp, c_acctbal as marker,
        cast(c_nationkey as double) as nation, cast(floor((last.day - first) / 30.0e0) as double) as duration,
        cast(last.status = 'F' as integer) as event, c_custkey as id
      from customer join (select o_custkey, min(day) as first,
          max({'day': day, 'o_orderkey': o_orderkey, 'status': o_orderstatus}) as last
        from (select *, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as day from orders)
        group by o_custkey) o on c_custkey = o_custkey""",
    "history": """
      select 'run' || cast(user_id % 5 as varchar) as run, cast(extract(day from ts) as integer) as epoch,
        event_id as seq, event_type as metric, value from events""",
    "report": """
      select cast(o_orderkey as varchar) as name, o_orderstatus = 'F' as ok, o_orderstatus = 'O' as existed,
        case when o_orderstatus = 'P' then 'failed' end as error from orders""",
    "masks": """
      select name, i * 4 + r as mi, j * 4 + c as mj, cast((vec_id * (r + 1) * (c + 3)) % 3 as integer) as v
      from tiles, (select unnest([0,1,2,3]) as r), (select unnest([0,1,2,3]) as c)""",
    "paths": "select '/img/p' || lpad(cast(page_id as varchar), 9, '0') || '.tif' as path, page_id from pages",
    "side_paths": """
      select '/mask/p' || lpad(cast(page_id as varchar), 9, '0') || '_tissue.tif' as path from pages where page_id % 7 <> 0
      union all
      select '/mask/p' || lpad(cast(page_id as varchar), 9, '0') || '_mask2.tif' from pages
        where page_id % 7 <> 0 and page_id % 5 = 0
      union all
      select '/mask/x' || cast(page_id as varchar) || '_tissue.tif' from pages where page_id % 7 <> 0 and page_id % 11 = 0""",
}

NEEDS = {"cohort_ml": ["cohort"], "preds": ["cohort"], "ensemble": ["cohort"], "preds_ml": ["cohort_ml"],
         "masks": ["tiles"]}


def with_views(sql: str, *views: str, **more: str) -> str:
    """Prefix ``sql`` with the CTEs of the named views, their prerequisites, and extra named subqueries."""
    order: list[str] = []

    def add(v: str) -> None:
        for need in NEEDS.get(v, []):
            add(need)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    parts = [f"{v} as ({SQL[v]})" for v in order] + [f"{k} as ({v})" for k, v in more.items()]
    return f"with recursive {', '.join(parts)}\n{sql}" if parts else sql
