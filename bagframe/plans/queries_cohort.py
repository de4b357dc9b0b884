"""Queries on cohort tables: selection, labels, joins, profiles, set operations, scalar functions, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagframe.functions import labels as L
from bagframe.functions import scalars as S
from bagframe.functions.stats import entropy, hoyer
from bagframe.operators import cohort as C
from bagframe.operators import joins as J
from bagframe.operators import matching as MA
from bagframe.operators import profile as PR
from bagframe.operators import telemetry as TL
from bagframe.operators.spec import CohortSpec, TrainType
from bagframe.plans import fixtures as fx
from bagframe.plans.registry import query

BINARY = CohortSpec(TrainType.CLF, ("Neg", "Pos"))
MULTI = CohortSpec(TrainType.MULTILABEL, ("other", "quality", "toxic"))


# ---------------------------------------------------------------- selection and labels

@query("rows_selected", "name:s split:s category:s",
       "select name, split, category from cohort where split in ('training', 'testing') and category in ('de', 'en')", "cohort")
def _(spark, sf):
    """Rows of two splits and two categories."""
    return C.select_rows(fx.cohort(spark, sf), BINARY, split=["training", "testing"], category=["de", "en"])


@query("rows_selected_by_level_and_names", "name:s",
       "select name from cohort where category2 = 'src1' and name in (select cast(vec_id as varchar) from embeddings)", "cohort")
def _(spark, sf):
    """Second category level, and names from a table."""
    names = fx.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("n"))
    return C.select_rows(fx.cohort(spark, sf), BINARY, category="src1", names=names, level=2)


@query("all_splits_selected", "name:s split:s", "select name, split from cohort", "cohort")
def _(spark, sf):
    """'all' means every split."""
    return C.select_split(fx.cohort(spark, sf), BINARY, "all")


@query("names_in_categories", "name:s", "select name from cohort where category in ('fr', 'es')", "cohort")
def _(spark, sf):
    return C.names_in_categories(fx.cohort(spark, sf), BINARY, ["fr", "es"])


@query("image_of_name", "name:s image:s", "select name, '/img/' || name || '.tif' as image from cohort where name = (select min(name) from cohort)", "cohort")
def _(spark, sf):
    df = fx.cohort(spark, sf).withColumn("image", F.concat(F.lit("/img/"), "name", F.lit(".tif, /old/x.tif")))
    return C.image_of(df, BINARY, df.agg(F.min("name")).first()[0])


@query("categories_deleted_and_renamed", "name:s category:s",
       "select name, case category when 'en' then 'english' when 'fr' then 'english' else category end as category from cohort where category <> 'de'",
       "cohort")
def _(spark, sf):
    """Renames are applied in order, so fr becomes en and then english."""
    df = C.delete_categories(fx.cohort(spark, sf), BINARY, "de")
    return C.rename_categories(df, BINARY, {"fr": "en", "en": "english"})


@query("labels_added", "name:s label:l classes:s",
       "select name, Pos as label, case when Pos = 1 then 'Pos' else 'Neg' end as classes from cohort", "cohort")
def _(spark, sf):
    return C.with_labels(fx.cohort(spark, sf), BINARY)


@query("labels_added_multilabel", "name:s label:s classes:s",
       """select name, concat_ws(',', case when other = 1 then '0' end, case when quality = 1 then '1' end, case when toxic = 1 then '2' end) as label,
            concat_ws(' ', case when other = 1 then 'other' end, case when quality = 1 then 'quality' end, case when toxic = 1 then 'toxic' end) as classes
          from cohort_ml""", "cohort_ml")
def _(spark, sf):
    df = C.with_labels(fx.cohort_ml(spark, sf), MULTI)
    return df.withColumn("label", F.array_join(F.col("label").cast("array<string>"), ","))


@query("labels_remapped", "name:s fine:l flagged:l",
       "select name, case when other = 1 or quality = 1 then 1 else 0 end as fine, toxic as flagged from cohort_ml", "cohort_ml")
def _(spark, sf):
    """Many-to-one remapping of one-hot columns."""
    return C.remap_labels(fx.cohort_ml(spark, sf), MULTI, {"other": "fine", "quality": "fine", "toxic": "flagged"},
                          ["fine", "flagged"])[0]


@query("secondary_label_deleted", "name:s other:l quality:l toxic:l",
       "select name, other, case when quality = 1 and other + toxic >= 1 then 0 else quality end as quality, toxic from cohort_ml", "cohort_ml")
def _(spark, sf):
    return C.delete_secondary_label(fx.cohort_ml(spark, sf), MULTI, "quality")


@query("splits_merged", "split:s n:l",
       "select case when split = 'testing' then split else 'train_valid' end as split, count(*) as n from cohort group by 1", "cohort")
def _(spark, sf):
    return PR.split_counts(C.merge_splits(fx.cohort(spark, sf), BINARY), BINARY)


@query("rows_with_missing", "name:s error:s",
       "select name, error from report where error is null", "report")
def _(spark, sf):
    return C.rows_with_missing(fx.report(spark, sf), ["error"])


@query("missing_dropped", "name:s error:s", "select name, error from report where error is not null", "report")
def _(spark, sf):
    return C.drop_missing(fx.report(spark, sf), ["name", "error"])


@query("nan_to_null", "n:l n_null:l", "select count(*) as n, count(*) filter (l_quantity > 40) as n_null from lineitem")
def _(spark, sf):
    """NaN becomes NULL, other values stay."""
    q = F.col("l_quantity")
    df = fx.table(spark, sf, "lineitem").select(F.when(q > 40, F.lit(float("nan"))).otherwise(q).alias("q"))
    return C.nan_to_null(df).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q").isNull()).alias("n_null"))


@query("columns_arranged", "Pos:l name:s category:s split:s",
       "select Pos, name, category, split from cohort", "cohort")
def _(spark, sf):
    """Columns moved first, after another, last, and deleted."""
    df = C.delete_columns(fx.cohort(spark, sf), "toxic, n_chars,doc_id, category2")
    return C.columns_last(C.column_after(C.columns_first(df, ["Pos"]), "category", "name"), ["split"])


@query("columns_normalised", "order_key:s price_total:d",
       "select cast(o_orderkey as varchar) as order_key, o_totalprice as price_total from orders")
def _(spark, sf):
    """Names with &, #, spaces and capitals; then a cast to text."""
    df = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias(" Order Key"), F.col("o_totalprice").alias("Price &#Total "))
    return C.column_to_string(C.normalise_columns(C.strip_columns(df)), "order_key")


@query("dictionary_lookup", "c_custkey:l nation:s",
       "select c_custkey, n_name as nation from customer left join nation on c_nationkey = n_nationkey")
def _(spark, sf):
    """Two columns of a table used as a dictionary."""
    return C.look_up(fx.table(spark, sf, "customer"), "c_nationkey", fx.table(spark, sf, "nation"), "n_nationkey", "n_name", "nation")


@query("image_paths_resolved", "name:s path:s",
       "select name, case when doc_id % 3 = 0 then '/a/' || name || '.tif' when doc_id % 3 = 1 then '/b/' || name || '.tif' else '/c/' || name || '.tif' end as path from cohort",
       "cohort")
def _(spark, sf):
    """First non-missing of three path columns, restricted to files that exist."""
    def p(d, k):
        return F.when(F.col("doc_id") % 3 <= k, F.concat(F.lit(f"/{d}/"), "name", F.lit(".tif")))

    df = fx.cohort(spark, sf).withColumns({"image": p("a", 0), "wsi_path": p("b", 1), "img": p("c", 2)})
    return df.select("name", C.image_path(df).alias("path"))


@query("single_label_rows", "name:s", "select name from cohort_ml where other + quality + toxic < 2", "cohort_ml")
def _(spark, sf):
    return C.single_label_rows(fx.cohort_ml(spark, sf), MULTI.target_cols)


@query("retry_set", "name:s error:s", "select name, error from report where not ok and not existed", "report")
def _(spark, sf):
    return C.retry_set(fx.report(spark, sf))


@query("targets_inferred", "n:l t0:l t1:l t2:l t3:l t4:l t5:l t6:l t7:l t8:l t9:l",
       """select count(*) as n, count(*) filter (label = 0) as t0, count(*) filter (label = 1) as t1, count(*) filter (label = 2) as t2,
            count(*) filter (label = 3) as t3, count(*) filter (label = 4) as t4, count(*) filter (label = 5) as t5, count(*) filter (label = 6) as t6,
            count(*) filter (label = 7) as t7, count(*) filter (label = 8) as t8, count(*) filter (label = 9) as t9 from embeddings""")
def _(spark, sf):
    """Integer targets are a classification and expand to one-hot columns."""
    kind, df, n = C.infer_targets(fx.table(spark, sf, "embeddings").select((F.col("label") + 3).alias("y")), "y")
    if kind is not TrainType.CLF:
        raise ValueError(kind)
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"t{k}").alias(f"t{k}") for k in range(n)])


# ---------------------------------------------------------------- joins

@query("merge_with_suffixes", "name:s split_x:s split_y:s",
       "select a.name, a.split as split_x, b.split as split_y from cohort a join preds b on a.name = b.name", ("cohort", "preds"))
def _(spark, sf):
    """Inner join with suffixes for clashing columns, row counts checked against the left side."""
    return J.merge(fx.cohort(spark, sf), fx.preds(spark, sf).select("name", "split"), "name", check="left")


@query("merge_counts", "left:l right:l merged:l left_only:l right_only:l",
       """select (select count(*) from orders) as "left", (select count(*) from customer) as "right", (select count(*) from orders join customer on o_custkey = c_custkey) as merged,
            (select count(*) from orders where o_custkey not in (select c_custkey from customer)) as left_only,
            (select count(*) from customer where c_custkey not in (select o_custkey from orders)) as right_only""")
def _(spark, sf):
    return J.merge_counts(fx.table(spark, sf, "orders"), fx.table(spark, sf, "customer"), "o_custkey", "c_custkey")


@query("merge_left_and_right_only", "side:s key:s",
       """select 'left' as side, cast(doc_id as varchar) as key from documents where doc_id not in (select doc_id from labels)
          union all select 'right', cast(doc_id as varchar) from labels where doc_id not in (select doc_id from documents)
          union all select 'left events', cast(user_id as varchar) from events where user_id not in (select c_custkey from customer)
          union all select 'right events', cast(c_custkey as varchar) from customer where c_custkey not in (select user_id from events)""")
def _(spark, sf):
    """Rows only on one side of a join."""
    def sides(left, right, lkey, rkey, tag):
        _, lo, ro = J.merge_check(left, right, lkey, rkey)
        return lo.select(F.lit("left" + tag).alias("side"), F.col(lkey).cast("string").alias("key")).unionByName(
            ro.select(F.lit("right" + tag).alias("side"), F.col(rkey).cast("string").alias("key")))

    labels = sides(fx.table(spark, sf, "documents"), fx.table(spark, sf, "labels"), "doc_id", "doc_id", "")
    return labels.unionByName(sides(fx.table(spark, sf, "events"), fx.table(spark, sf, "customer"), "user_id", "c_custkey", " events"))


@query("cohort_strict_merge", "name:s split:s chars:l",
       "select name, split, n_chars as chars from cohort", "cohort")
def _(spark, sf):
    """Cohort joined to a table by name: no column clash, row count kept."""
    info = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("name"), F.col("n_chars").alias("chars"))
    return J.strict_merge(fx.cohort(spark, sf), info, BINARY)


@query("paths_attached", "name:s image:s",
       "select name, case when doc_id % 2 = 0 then '/even/' else '/odd/' end || name as image from cohort", "cohort")
def _(spark, sf):
    """Image column replaced from two path tables."""
    c = fx.cohort(spark, sf).withColumn("image", F.lit("old"))
    def part(k, d):
        return c.where(F.col("doc_id") % 2 == k).select("name", F.concat(F.lit(d), "name").alias("path"))

    return J.attach_paths(c, BINARY, part(0, "/even/"), part(1, "/odd/"))


@query("bags_attached", "name:s n_tiles:l", "select 'b' || cast(k as varchar) as name, count(*) as n_tiles from (select vec_id % 25 as k from embeddings) group by k")
def _(spark, sf):
    """Cohort of bags joined to the bag inventory; a duplicate name is an error."""
    t = fx.tiles(spark, sf)
    inv = t.groupBy("name").agg(F.count(F.lit(1)).alias("n_tiles"))
    cohort = t.select("name").distinct().withColumns({"split": F.lit("default"), "Neg": F.lit(0), "Pos": F.lit(1)})
    return J.attach_bags(cohort, BINARY, inv)


@query("items_not_done", "name:s", "select name from cohort where name not in (select name from preds where split = 'training')", ("cohort", "preds"))
def _(spark, sf):
    """Inputs without a row in the output table."""
    return J.not_done(fx.cohort(spark, sf), fx.preds(spark, sf).where("split = 'training'"), "name")


@query("names_popped", "part:s name:s",
       """select 'popped' as part, name from cohort where split = 'validation'
          union all select 'rest', name from cohort where category2 not in (select category2 from cohort where split = 'validation')""", "cohort")
def _(spark, sf):
    """Listed names taken out together with every row that shares their id (here the second category)."""
    c = fx.cohort(spark, sf)
    popped, rest = J.pop_names(c, c.where("split = 'validation'"), BINARY, "category2")
    return popped.select(F.lit("popped").alias("part"), "name").unionByName(rest.select(F.lit("rest").alias("part"), "name"))


@query("split_overlap", "split1:s split2:s category:s",
       """select distinct a.split as split1, b.split as split2, a.category from cohort a join cohort b
          on a.category = b.category and a.split < b.split""", "cohort")
def _(spark, sf):
    """Ids (here the category) that occur in both splits of a pair."""
    return J.split_overlap(fx.cohort(spark, sf), BINARY, "category")


@query("table_upsert", "c_custkey:l c_acctbal:d n_orders:l",
       """select c_custkey, case when n % 2 = 0 then total else c_acctbal end as c_acctbal, n as n_orders from customer left join (
            select o_custkey, count(*) as n, sum(o_totalprice) as total from orders group by o_custkey) on c_custkey = o_custkey""", digits=2)
def _(spark, sf):
    """Non-null patch values replace old ones, new columns are appended."""
    o = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("t"))
    o = o.select("c_custkey", "n_orders", F.when(F.col("n_orders") % 2 == 0, F.col("t")).alias("c_acctbal"))
    return J.upsert(fx.table(spark, sf, "customer"), o, "c_custkey")


# ---------------------------------------------------------------- matching

_PATHS = """select path, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '') as stem from {t}"""


@query("prefix_matches", "name:s path:s n_hits:l",
       """select i.stem as name, first(s.path order by length(s.path), s.path) as path, count(s.path) as n_hits
          from i left join s on starts_with(s.stem, i.stem) group by i.stem""", ("paths", "side_paths"),
       i=_PATHS.format(t="paths"), s=_PATHS.format(t="side_paths"))
def _(spark, sf):
    """Files whose stem starts with a name: shortest hit, number of hits."""
    names = fx.paths(spark, sf).select(S.stem("path").alias("name"))
    return MA.match_paths(names, fx.side_paths(spark, sf), "name", take_shortest=True)


@query("exact_name_matches", "name:s path:s",
       """select i.stem as name, s.path from i join s on replace(s.stem, '_tissue', '') = i.stem""", ("paths", "side_paths"),
       i=_PATHS.format(t="paths"), s=_PATHS.format(t="side_paths"))
def _(spark, sf):
    """Equal stems after replacing text; names without hit are dropped."""
    names = fx.paths(spark, sf).select(S.stem("path").alias("name"))
    return MA.match_paths(names, fx.side_paths(spark, sf), "name", same_name=True, replacements={"_tissue": ""}, missing="drop")


@query("unmatched_paths", "side:s path:s",
       """select 'source' as side, path from i where not exists (select 1 from s where starts_with(s.stem, i.stem))
          union all select 'target', path from s where path not in (
            select first(s.path order by length(s.path), s.path) from i join s on starts_with(s.stem, i.stem) group by i.stem)""",
       ("paths", "side_paths"), i=_PATHS.format(t="paths"), s=_PATHS.format(t="side_paths"))
def _(spark, sf):
    """Sources and targets without a match."""
    _, a, b = MA.match_both_ways(fx.paths(spark, sf).select("path"), fx.side_paths(spark, sf))
    return a.select(F.lit("source").alias("side"), "path").unionByName(b.select(F.lit("target").alias("side"), "path"))


@query("link_table", "image:s annotation:s mask:s",
       """select * from (select i.path as image, max(a.path) as annotation, first(s.path order by length(s.path), s.path) as mask from i
            left join a on a.stem = i.stem left join s on starts_with(s.stem, i.stem) group by i.path)
          where mask is not null""", ("paths", "side_paths"),
       i=_PATHS.format(t="paths"), s=_PATHS.format(t="side_paths"),
       a="""select case when page_id % 4 = 0 then '/new/' else '/old/' end || 'p' || lpad(cast(page_id as varchar), 9, '0') || '.xml' as path,
            'p' || lpad(cast(page_id as varchar), 9, '0') as stem from pages where page_id % 2 = 0""")
def _(spark, sf):
    """Image, annotation and mask per image; of two annotation folders the first wins; only images with a mask."""
    p = fx.paths(spark, sf)

    def xml(d, step):
        return p.where(F.col("page_id") % step == 0).select(F.concat(F.lit(f"/{d}/"), S.stem("path"), F.lit(".xml")).alias("path"))

    return MA.link_table(p.select("path"), [xml("new", 4), xml("old", 2)], fx.side_paths(spark, sf), only_with_mask=True,
                         take_shortest=True)


# ---------------------------------------------------------------- profiles

@query("label_ratios", "label:l n:l ratio:d",
       "select Pos as label, count(*) as n, count(*) / cast(sum(count(*)) over () as double) as ratio from cohort where split = 'training' group by Pos", "cohort")
def _(spark, sf):
    return PR.label_ratios(fx.cohort(spark, sf), BINARY, "training")


@query("label_ratios_multilabel", "label:l n:l ratio:d",
       """select label, n, n / cast(sum(n) over () as double) as ratio from (select 0 as label, sum(other) as n from cohort_ml
          union all select 1, sum(quality) from cohort_ml union all select 2, sum(toxic) from cohort_ml)""", "cohort_ml")
def _(spark, sf):
    """Relative to the sum of all label counts."""
    return PR.label_ratios(fx.cohort_ml(spark, sf), MULTI)


@query("category_ratios", "category:s n:l ratio:d",
       "select category, count(*) as n, count(*) / cast(sum(count(*)) over () as double) as ratio from cohort group by category", "cohort")
def _(spark, sf):
    return PR.category_ratios(fx.cohort(spark, sf), BINARY)


@query("split_counts", "split:s n:l", "select split, count(*) as n from cohort group by split", "cohort")
def _(spark, sf):
    return PR.split_counts(fx.cohort(spark, sf), BINARY)


@query("cohort_summary", "split:s category:s labels:s n:l ratio:d",
       """select case when grouping(split) = 1 then 'all' else split end as split, case when grouping(category) = 1 then 'all' else category end as category,
            case when grouping(Pos) = 1 then 'all' else cast(Pos as varchar) end as labels, count(*) as n,
            count(*) / (select cast(count(*) as double) from cohort) as ratio
          from cohort group by grouping sets ((split), (category), (split, category), (split, category, Pos))""", "cohort")
def _(spark, sf):
    return PR.cohort_summary(fx.cohort(spark, sf), BINARY)


@query("target_values", "value:l", "select distinct Pos as value from cohort", "cohort")
def _(spark, sf):
    return PR.target_values(fx.cohort(spark, sf), BINARY)


@query("categories_in_order", "category:s rank:l",
       "select category, row_number() over (order by category desc) - 1 as rank from (select distinct category from cohort)", "cohort")
def _(spark, sf):
    """Distinct categories in a given order, which must be the same set."""
    df = fx.cohort(spark, sf)
    return PR.categories(df, CohortSpec(TrainType.CLF, ("Neg", "Pos"), categories_order=("fr", "es", "en", "de")))


@query("value_counts", "col:s val:s count:l",
       """select 'error' as col, error as val, count(*) as count from report group by error
          union all select 'ok', cast(ok as varchar), count(*) from report group by ok""", "report")
def _(spark, sf):
    """Missing values counted separately."""
    return PR.value_counts(fx.report(spark, sf), ["error", "ok"])


@query("value_count_matrix", "value:s ok:l existed:l row_sum:l",
       """select v as value, count(*) filter (c = 'ok') as ok, count(*) filter (c = 'existed') as existed, count(*) as row_sum from (
            select 'ok' as c, cast(ok as varchar) as v from report union all select 'existed', cast(existed as varchar) from report) group by v
          union all select 'col_sum', count(*), count(*), 2 * count(*) from report""", "report")
def _(spark, sf):
    """Union of values x columns with margins."""
    return PR.value_count_matrix(fx.report(spark, sf), ["ok", "existed"])


@query("column_stats", "var:s mean:d min:d max:d std:d",
       """select 'l_quantity' as var, avg(l_quantity) as mean, min(l_quantity) as min, max(l_quantity) as max, stddev_samp(l_quantity) as std from lineitem
          union all select 'l_discount', avg(l_discount), min(l_discount), max(l_discount), stddev_samp(l_discount) from lineitem""")
def _(spark, sf):
    return PR.column_stats(fx.table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])


@query("group_entropy_and_sparseness", "l_returnflag:s entropy:d hoyer:d",
       """select l_returnflag, (ln(sum(l_quantity)) - sum(l_quantity * ln(l_quantity)) / sum(l_quantity)) / ln(count(*)) as entropy,
            (sqrt(count(*)) - sum(l_quantity) / sqrt(sum(l_quantity * l_quantity))) / (sqrt(count(*)) - 1) as hoyer
          from lineitem group by l_returnflag""")
def _(spark, sf):
    """Normalised entropy and Hoyer sparseness of a column per group."""
    return fx.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        entropy("l_quantity").alias("entropy"), hoyer("l_quantity").alias("hoyer"))


@query("group_mode_lowest", "o_custkey:l o_orderstatus:s n:l",
       """select o_custkey, o_orderstatus, n from (select *, row_number() over (partition by o_custkey order by n desc, o_orderstatus) as r from (
            select o_custkey, o_orderstatus, count(*) as n from orders group by all)) where r = 1""")
def _(spark, sf):
    """Most frequent value per group, the lowest on a tie."""
    return PR.group_mode(fx.table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus")


@query("group_mode_highest", "o_custkey:l o_orderstatus:s n:l",
       """select o_custkey, o_orderstatus, n from (select *, row_number() over (partition by o_custkey order by n desc, o_orderstatus desc) as r from (
            select o_custkey, o_orderstatus, count(*) as n from orders group by all)) where r = 1""")
def _(spark, sf):
    """Most frequent value per group, the highest on a tie."""
    return PR.group_mode(fx.table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", highest=True)


@query("duplicate_keys", "l_orderkey:l l_linenumber:l l_partkey:l",
       "select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in (select l_orderkey from lineitem group by l_orderkey having count(*) > 1)")
def _(spark, sf):
    """All copies of keys that occur more than once."""
    return PR.duplicates(fx.table(spark, sf, "lineitem"), "l_orderkey")


@query("unique_value_per_group", "name:s split:s Pos:l", "select name, max(split) as split, max(Pos) as Pos from ensemble group by name", "ensemble")
def _(spark, sf):
    """The single value of columns that must agree inside a group."""
    return fx.ensemble(spark, sf).groupBy("name").agg(PR.unique_one("split").alias("split"), PR.unique_one("Pos").alias("Pos"))


@query("joined_text_per_group", "category:s splits:s all_pos:s",
       """select category, string_agg(distinct split, ', ' order by split) as splits, string_agg(cast(Pos as varchar), '' order by cast(Pos as varchar)) as all_pos
          from cohort group by category""", "cohort")
def _(spark, sf):
    """Sorted text of a group, unique or with repeats."""
    return fx.cohort(spark, sf).groupBy("category").agg(
        PR.joined_text("split", unique=True).alias("splits"), PR.joined_text("Pos", "").alias("all_pos"))


@query("inconsistent_group_ids", "group_col:s other_col:s p_partkey:l",
       """select 'p_name' as group_col, 'p_brand' as other_col, p_partkey from part where p_name in (select p_name from part group by p_name having count(distinct p_brand) > 1)
          union all select 'p_brand', 'p_name', p_partkey from part where p_brand in (select p_brand from part group by p_brand having count(distinct p_name) > 1)""")
def _(spark, sf):
    """Rows whose group id goes with several other ids, for every ordered pair of id columns."""
    return PR.inconsistent_groups(fx.table(spark, sf, "part"), ["p_name", "p_brand"])


@query("cooccurrence_matrix", "var:s toxic:l other:l quality:l",
       """select 'toxic' as var, sum(toxic) as toxic, sum(toxic * other) as other, sum(toxic * quality) as quality from cohort_ml
          union all select 'other', sum(other * toxic), sum(other), sum(other * quality) from cohort_ml
          union all select 'quality', sum(quality * toxic), sum(quality * other), sum(quality) from cohort_ml""", "cohort_ml")
def _(spark, sf):
    """X'X of the class columns, in another class order."""
    return PR.cooccurrence(fx.cohort_ml(spark, sf), MULTI.target_cols, ["toxic", "other", "quality"])


@query("single_label_cooccurrence", "var:s other:l quality:l toxic:l",
       """select 'other' as var, sum(other) as other, 0 as quality, 0 as toxic from s union all select 'quality', 0, sum(quality), 0 from s
          union all select 'toxic', 0, 0, sum(toxic) from s""", "cohort_ml", s="select * from cohort_ml where other + quality + toxic < 2")
def _(spark, sf):
    return PR.cooccurrence(C.single_label_rows(fx.cohort_ml(spark, sf), MULTI.target_cols), MULTI.target_cols)


@query("run_status", "n:l n_ok:l n_existed:l n_error:l all_ok:b",
       """select count(*) as n, count(*) filter (ok) as n_ok, count(*) filter (existed) as n_existed, count(error) as n_error,
            bool_and(ok or existed) as all_ok from report""", "report")
def _(spark, sf):
    return PR.run_status(fx.report(spark, sf))


@query("directory_sizes", "directory:s n:l bytes:l",
       """select regexp_replace(url, '/[^/]*$', '') as directory, count(*) as n, sum(length(html)) as bytes from pages group by 1""")
def _(spark, sf):
    """Number and total size of entries per folder, here of page addresses."""
    return PR.directory_sizes(fx.table(spark, sf, "pages").select(F.col("url").alias("path"), F.length("html").alias("length")))


@query("mean_of_metrics", "run:s epoch:l mean:d",
       """select run, epoch, (max(case when metric = 'click' then v end) + max(case when metric = 'view' then v end)) / 2 as mean from (
            select run, epoch, metric, max_by(value, seq) as v from history group by all) group by run, epoch""", "history")
def _(spark, sf):
    """Mean of two metrics where both are present."""
    return TL.epoch_table(fx.history(spark, sf), ["click", "view"], None).withColumn("mean", PR.mean_of_metrics(["click", "view"]))


# ---------------------------------------------------------------- set operations

@query("tables_concatenated", "name:s split:s out1:d",
       "select name, split, cast(null as double) as out1 from cohort union all select name, split, out1 from preds", ("cohort", "preds"))
def _(spark, sf):
    """Union by name with missing columns."""
    return C.concat(fx.cohort(spark, sf), fx.preds(spark, sf))


@query("cohorts_added", "name:s split:s Pos:l",
       "select name, split, Pos from cohort union all select 'x' || name, split, Pos from cohort where split = 'testing'", "cohort")
def _(spark, sf):
    c = fx.cohort(spark, sf)
    other = c.where("split = 'testing'").withColumn("name", F.concat(F.lit("x"), "name"))
    return C.add_cohort(c, other, BINARY, same_cols=True)


@query("list_surpluses", "part:s key:l",
       """select 'both' as part, user_id as key from events where user_id in (select o_custkey from orders)
          union all select 'left', user_id from events where user_id not in (select o_custkey from orders)
          union all select 'right', o_custkey from orders where o_custkey not in (select user_id from events)""")
def _(spark, sf):
    """Intersection and both surpluses; duplicates of the left list are kept."""
    users = fx.table(spark, sf, "events").select(F.col("user_id").alias("key"))
    orders = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    parts = zip(("both", "left", "right"), C.surpluses(users, orders, "key"))
    return C.concat(*[d.withColumn("part", F.lit(p)) for p, d in parts])


@query("distinct_difference", "key:l",
       "select vec_id as key from embeddings except select doc_id from labels")
def _(spark, sf):
    vectors = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"))
    return C.distinct_difference(vectors, fx.table(spark, sf, "labels").select(F.col("doc_id").alias("key")), "key")


@query("distinct_in_order", "user_id:l event_type:s event_id:l",
       "select user_id, first(event_type order by event_id) as event_type, min(event_id) as event_id from events group by user_id")
def _(spark, sf):
    """First row of every key by position."""
    df = fx.table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return C.distinct_in_order(df, "user_id", "event_id")


@query("lists_inverted", "value:s keys:s",
       "select category2 as value, string_agg(category, ',' order by category) as keys from (select distinct category, category2 from cohort) group by category2", "cohort")
def _(spark, sf):
    """key -> values turned into value -> keys."""
    lists = fx.cohort(spark, sf).groupBy("category").agg(F.collect_set("category2").alias("v"))
    return C.invert_lists(lists, "category", "v").withColumn("keys", F.array_join("keys", ","))


@query("unique_lists_inverted", "value:s key:s", "select name as value, split as key from cohort", "cohort")
def _(spark, sf):
    lists = fx.cohort(spark, sf).groupBy("split", "category2").agg(F.collect_list("name").alias("v"))
    return C.invert_unique_lists(lists, "split", "v")


# ---------------------------------------------------------------- scalar functions

@query("one_hot_from_text", "name:s other:l quality:l toxic:l",
       "select name, other, quality, toxic from cohort_ml", "cohort_ml")
def _(spark, sf):
    """Label text separated by commas or pipes, single labels, and empty text."""
    df = C.with_labels(fx.cohort_ml(spark, sf), MULTI)
    sep = F.when(F.col("doc_id") % 2 == 0, ",").otherwise("|")
    df = df.select("name", F.replace(F.col("classes"), F.lit(" "), sep).alias("text"))
    return df.select("name", *L.one_hot(L.split_labels("text"), MULTI.target_cols))


@query("label_index_forms", "name:s worst:l highest:l first:l",
       """select name, case when toxic = 1 then 2 when quality = 1 then 1 else 0 end as worst, case when toxic = 1 then 2 when quality = 1 then 1 else 2 end as highest,
            case when quality >= toxic then 0 else 1 end as first from cohort_ml""", "cohort_ml")
def _(spark, sf):
    """Worst label, highest of a subset with an unlabelled row as the last class, and argmax."""
    sub = F.coalesce(F.array_max(L.label_indices(["quality", "toxic"])) + 1, F.lit(2))
    return fx.cohort_ml(spark, sf).select("name", L.worst_label(MULTI.target_cols).alias("worst"), sub.alias("highest"),
                                          L.argmax(["quality", "toxic"]).alias("first"))


@query("output_functions", "name:s softmax0:d sigmoid0:d tanh0:d surv1:d surv0:d identity0:d label:l strict:s",
       """select name, out0 as softmax0, 1 / (1 + exp(-logit0)) as sigmoid0, tanh(logit0) as tanh0, exp(-logit0) as surv1, 1 / (1 + exp(-logit0)) as surv0,
            logit0 as identity0, case when logit0 >= logit1 and logit0 >= logit2 then 0 when logit1 >= logit2 then 1 else 2 end as label,
            cast(cast(logit0 > 0 as integer) as varchar) || cast(cast(logit1 > 0 as integer) as varchar) || cast(cast(logit2 > 0 as integer) as varchar) as strict
          from preds3""", "preds3")
def _(spark, sf):
    """Output functions of all train types and the predicted labels."""
    z = ["logit0", "logit1", "logit2"]
    sig = L.post_process(z, "sigmoid", 3)
    return fx.preds3(spark, sf).select(
        "name", L.post_process(z, "softmax", 3)[0].alias("softmax0"), sig[0].alias("sigmoid0"),
        L.post_process(z, "tanh", 3)[0].alias("tanh0"), L.post_process(z[:1], "surv", 1)[0].alias("surv1"),
        L.post_process(z, "surv", 3)[0].alias("surv0"), L.post_process(z, None, 3)[0].alias("identity0"),
        L.predicted_labels(z, "clf").alias("label"),
        F.array_join(L.predicted_labels(sig, "multilabel", strict=True).cast("array<string>"), "").alias("strict"))


@query("array_unrolled", "vec_id:l " + " ".join(f"v{k}:d" for k in range(64)),
       "select vec_id, " + ", ".join(f"embedding[{k + 1}] as v{k}" for k in range(64)) + " from embeddings")
def _(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", *L.unroll("embedding", 64, "v"))


@query("hazards_to_survival", "name:s s0:d s1:d s2:d risk:d",
       """select name, h0 as s0, h0 * h1 as s1, h0 * h1 * h2 as s2, (1 / (1 + exp(-logit0)) + 1 / (1 + exp(-logit1)) + 1 / (1 + exp(-logit2))) / 3 as risk from (
            select *, 1 - 1 / (1 + exp(-logit0)) + 1e-7 as h0, 1 - 1 / (1 + exp(-logit1)) + 1e-7 as h1, 1 - 1 / (1 + exp(-logit2)) + 1e-7 as h2 from preds3)""", "preds3")
def _(spark, sf):
    """Discrete hazard logits to survival per bin, and the mean sigmoid as one risk."""
    z = F.array("logit0", "logit1", "logit2")
    s = L.hazards_to_survival(z)
    sig = L.post_process(z, "sigmoid", 3)
    df = fx.preds3(spark, sf).select("name", *[s[k].alias(f"s{k}") for k in range(3)], *[sig[k].alias(f"g{k}") for k in range(3)])
    return df.withColumn("risk", L.row_mean(["g0", "g1", "g2"]))


@query("unit_conversions", "l_orderkey:l l_linenumber:l mm2:d px:d um2:d dist_px:l px_dist:l",
       """select l_orderkey, l_linenumber, l_extendedprice * (0.3e0 * 0.3e0) / 1e6 as mm2, l_quantity * 1e6 / (0.3e0 * 0.3e0) as px,
            l_extendedprice * (0.3e0 * 0.3e0) as um2, round_even(l_quantity / 2.0e0, 0) as dist_px, round_even(l_quantity * 0.5e0, 0) as px_dist from lineitem""")
def _(spark, sf):
    """Pixel, millimetre and micrometre conversions, rounding half to even."""
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", S.px_to_mm2(F.col("l_extendedprice"), 0.3).alias("mm2"),
        S.mm2_to_px(F.col("l_quantity"), 0.3).alias("px"), S.px_to_um2(F.col("l_extendedprice"), 0.3).alias("um2"),
        S.distance_to_px(F.col("l_quantity"), 2.0).alias("dist_px"), S.px_to_distance(F.col("l_quantity"), 0.5).alias("px_dist"))


@query("columns_to_mm2", "o_orderkey:l area:d tils_area:d",
       "select o_orderkey, o_totalprice * 4 / 1e6 as area, o_totalprice as tils_area from orders")
def _(spark, sf):
    """Listed pixel columns converted, tils columns and missing ones left alone."""
    df = fx.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("area"), F.col("o_totalprice").alias("tils_area"))
    return S.columns_to_mm2(df, ["area", "tils_area", "absent"], 2.0)


@query("path_parts", "url:s stem:s suffix:s short:s stripped:s",
       """select url, regexp_replace(n, '(.)\\.[^.]+$', '\\1') as stem, regexp_extract(n, '.(\\.[^.]+)$', 1) as suffix, split_part(n, '.', 1) as short,
            regexp_replace(url, '(^|\\.)[^.]*$', '') as stripped from (select url, regexp_extract(url, '([^/]*)$', 1) as n from pages)""")
def _(spark, sf):
    """Stem, suffix, stem up to the first dot, and text without its last ending."""
    return fx.table(spark, sf, "pages").select("url", S.stem("url").alias("stem"), S.suffix("url").alias("suffix"),
                                               S.short_stem("url").alias("short"), S.strip_ending("url").alias("stripped"))


@query("ascii_text", "doc_id:l chars:l hash:s",
       "select doc_id, length(t) as chars, md5(t) as hash from (select doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') as t from documents)")
def _(spark, sf):
    """Whole texts without non-ASCII characters."""
    t = fx.table(spark, sf, "documents").select("doc_id", S.strip_non_ascii("text").alias("t"))
    return t.select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("hash"))


@query("values_parsed", "name:s number:d flag:b items:s a:d",
       """select name, out1 as number, Pos = 1 as flag, cast(Neg as varchar) || ',' || cast(Pos as varchar) as items, out0 as a from preds""", "preds")
def _(spark, sf):
    """Numbers, booleans, lists and maps read back from text."""
    p = fx.preds(spark, sf)
    t = p.select("name", F.col("out1").cast("string").alias("n"), F.when(F.col("Pos") == 1, "True").otherwise("false").alias("b"),
                 F.concat(F.lit("["), "Neg", F.lit(", "), "Pos", F.lit("]")).alias("l"),
                 F.concat(F.lit("{a: "), F.col("out0").cast("string"), F.lit(", b: 1}")).alias("m"))
    return t.select("name", S.parse_number("n").alias("number"), S.parse_boolean("b").alias("flag"),
                    F.array_join(S.parse_list("l", "int").cast("array<string>"), ",").alias("items"),
                    S.parse_map("m")["a"].alias("a"))


@query("duration_text", "o_orderkey:l text:s",
       """select o_orderkey, case when s = 0 then '0s' when s <= 1e-4 then printf('%.2fms', s * 1000) when s < 1 then printf('%.4fs', s)
            when s >= 86400 then printf('%dd%dh%02dm%02ds', cast(floor(s / 86400) as bigint), cast(floor(s / 3600) as bigint) % 24, cast(floor(s / 60) as bigint) % 60, cast(floor(s) as bigint) % 60)
            when s >= 3600 then printf('%dh%02dm%02ds', cast(floor(s / 3600) as bigint), cast(floor(s / 60) as bigint) % 60, cast(floor(s) as bigint) % 60)
            when s >= 60 then printf('%02dm%02ds', cast(floor(s / 60) as bigint), cast(floor(s) as bigint) % 60)
            else printf('%ds', cast(floor(s) as bigint)) end as text
          from (select o_orderkey, case o_orderkey % 4 when 0 then o_totalprice when 1 then o_totalprice / 100 when 2 then o_totalprice / 1e6 else o_totalprice / 5000 end as s from orders)""")
def _(spark, sf):
    """Seconds as days, hours, minutes and seconds."""
    k, p = F.col("o_orderkey") % 4, F.col("o_totalprice")
    s = F.when(k == 0, p).when(k == 1, p / 100).when(k == 2, p / 1e6).otherwise(p / 5000)
    return fx.table(spark, sf, "orders").select("o_orderkey", S.duration_text(s).alias("text"))


@query("nested_flattened", "event_id:l k:l props_user:l deep:l",
       "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, user_id as props_user, user_id + 1 as deep from events")
def _(spark, sf):
    """Nested columns to dotted names, and a dotted lookup in JSON."""
    e = fx.table(spark, sf, "events").select("event_id", F.struct(F.col("user_id").alias("user"), F.struct(
        (F.col("user_id") + 1).alias("z")).alias("y")).alias("a"), S.nested_get("props", "k").alias("k"))
    return S.flatten(e).select("event_id", "k", F.col("`a.user`").alias("props_user"), F.col("`a.y.z`").alias("deep"))


@query("array_values_remapped", "name:s labels:s",
       """select name, concat_ws(',', case when other = 1 then '7' end, case when quality = 1 then '2' end, case when toxic = 1 then '1' end) as labels
          from cohort_ml""", "cohort_ml")
def _(spark, sf):
    """0 -> 7 and a simultaneous swap of 1 and 2."""
    a = S.remap_values(L.label_indices(MULTI.target_cols), {0: 7, 1: 2, 2: 1})
    return fx.cohort_ml(spark, sf).select("name", F.array_join(a.cast("array<string>"), ",").alias("labels"))


@query("finite_values", "l_returnflag:s total:d", "select l_returnflag, sum(l_extendedprice) as total from lineitem group by l_returnflag", digits=2)
def _(spark, sf):
    """A column that must not hold NaN or infinite values."""
    df = fx.table(spark, sf, "lineitem").withColumn("v", S.require_finite("l_extendedprice"))
    return df.groupBy("l_returnflag").agg(F.sum("v").alias("total"))


@query("spacing_levels", "p_partkey:l closest:l first:l thumb:l",
       """select p_partkey, case when least(abs(b - 1), abs(2 * b - 1), abs(4 * b - 1)) <= 0.25e0 then
              case when abs(b - 1) <= abs(2 * b - 1) and abs(b - 1) <= abs(4 * b - 1) then 0 when abs(2 * b - 1) <= abs(4 * b - 1) then 1 else 2 end end as closest,
            case when abs(b - 1) <= 0.25e0 then 0 when abs(2 * b - 1) <= 0.25e0 then 1 when abs(4 * b - 1) <= 0.25e0 then 2 end as first,
            case when s * s <= 400 then 0 when (s // 2) * (s // 2) <= 400 then 1 else 2 end as thumb
          from (select p_partkey, p_size / 40.0e0 as b, p_size as s from part)""")
def _(spark, sf):
    """Nearest level, first level within tolerance, and thumbnail level of three-level images."""
    b, s = F.col("p_size") / 40.0, F.col("p_size")
    sp = F.array(b, 2 * b, 4 * b)
    shapes = F.array(*[F.struct(F.floor(s / f).alias("h"), F.floor(s / f).alias("w")) for f in (1, 2, 4)])
    return fx.table(spark, sf, "part").select("p_partkey", S.closest_level(sp, 1.0).alias("closest"),
                                              S.first_level_within(sp, 1.0).alias("first"), S.thumbnail_level(shapes, 400).alias("thumb"))


@query("closest_numbers", "p_partkey:l closest:l idx:l larger:l smaller:l",
       """select p_partkey, case when abs(10 - p_size) <= abs(40 - p_size) and abs(10 - p_size) <= abs(25 - p_size) then 10 when abs(40 - p_size) <= abs(25 - p_size) then 40 else 25 end as closest,
            case when abs(10 - p_size) <= abs(40 - p_size) and abs(10 - p_size) <= abs(25 - p_size) then 0 when abs(40 - p_size) <= abs(25 - p_size) then 1 else 2 end as idx,
            case when p_size <= 10 then 10 when p_size <= 40 then 40 end as larger, case when p_size >= 40 then 40 when p_size >= 25 then 25 when p_size >= 10 then 10 end as smaller from part""")
def _(spark, sf):
    """Nearest, first not smaller, and largest not greater of the list (10, 40, 25)."""
    n, x = F.array(F.lit(10), F.lit(40), F.lit(25)), F.col("p_size")
    return fx.table(spark, sf, "part").select("p_partkey", S.closest_number(n, x).alias("closest"), S.closest_number_index(n, x).alias("idx"),
                                              S.first_not_smaller(n, x).alias("larger"), S.largest_not_greater(n, x).alias("smaller"))


@query("grey_values", "vec_id:l k:l grey:d",
       """select vec_id, k, cast(embedding[3 * k + 1] as double) * 0.299e0 + cast(embedding[3 * k + 2] as double) * 0.587e0
            + cast(embedding[3 * k + 3] as double) * 0.114e0 as grey from embeddings, range(0, 21) t(k)""")
def _(spark, sf):
    """Grey values of all 21 triples of every vector."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    triples = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: S.grey_value(F.get(e, 3 * k), F.get(e, 3 * k + 1), F.get(e, 3 * k + 2)))
    return fx.table(spark, sf, "embeddings").select("vec_id", F.posexplode(triples).alias("k", "grey"))


# ---------------------------------------------------------------- sort and telemetry

@query("sorted_head", "o_orderkey:l o_totalprice:d", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def _(spark, sf):
    """Best rows of a table by a metric (a report of the first 25)."""
    return TL.sort_by_metric(fx.table(spark, sf, "orders"), "o_totalprice", "o_orderkey").limit(25)


@query("metrics_cleaned", "run:s metric:s n:l",
       """select run, case when metric = 'view' and run <> 'run0' then 'lr' when metric = 'view' then 'lr-a' when metric = 'error' and run = 'run0' then 'lr-b' else metric end as metric,
            count(*) as n from history where metric <> 'click' group by 1, 2""", "history")
def _(spark, sf):
    """Step metrics dropped; a run's only learning rate becomes lr."""
    m, r = F.col("metric"), F.col("run")
    name = F.when(m == "click", "loss_step").when(m == "view", "lr-a").when((m == "error") & (r == "run0"), "lr-b").otherwise(m)
    return TL.clean_metrics(fx.history(spark, sf).withColumn("metric", name)).groupBy("run", "metric").agg(F.count(F.lit(1)).alias("n"))


@query("last_metric_values", "run:s epoch:l metric:s value:d",
       "select run, epoch, metric, max_by(value, seq) as value from history group by all", "history")
def _(spark, sf):
    return TL.last_values(fx.history(spark, sf))


_WIDE = """select run, epoch, max(case when metric = 'click' then v end) as click, max(case when metric = 'view' then v end) as val_auc,
    max(case when metric = 'error' and not (run in ('run1', 'run3') and epoch = (select max(epoch) from history)) then v end) as lr
  from (select run, epoch, metric, max_by(value, seq) as v from history group by all) group by run, epoch"""


@query("epoch_table", "run:s epoch:l click:d lr:d",
       """select run, epoch, click, case when lead(epoch) over w is null then coalesce(lr, lag(lr) over w) else lr end as lr
          from wide window w as (partition by run order by epoch)""", "history", wide=_WIDE)
def _(spark, sf):
    """One row per epoch, last value wins; a missing final lr is carried over."""
    h = fx.history(spark, sf)
    last = h.agg(F.max("epoch")).scalar()
    gone = (F.col("metric") == "error") & F.col("run").isin("run1", "run3") & (F.col("epoch") == last)
    h = h.where(~gone).withColumn("metric", F.when(F.col("metric") == "error", "lr").otherwise(F.col("metric")))
    return TL.epoch_table(h, ["click", "lr"])


@query("best_epochs", "run:s best_epoch:l best_value:d stop_epoch:l",
       """select run, arg_max(epoch, {'v': v, 'e': -epoch}) as best_epoch, max(v) as best_value, max(stop) as stop_epoch from (
            select *, coalesce(min(case when since >= 3 then epoch end) over (partition by run), max(epoch) over (partition by run)) as stop from (
              select *, n - max(case when fresh then n end) over (partition by run order by epoch) as since from (
                select run, epoch, val_auc as v, row_number() over w as n,
                  coalesce(val_auc > max(val_auc) over (partition by run order by epoch rows between unbounded preceding and 1 preceding), true) as fresh
                from wide where val_auc is not null window w as (partition by run order by epoch))))
          where epoch <= stop group by run""", "history", wide=_WIDE)
def _(spark, sf):
    """Best epoch by the monitor and the early-stop epoch with patience 3."""
    h = fx.history(spark, sf).withColumn("metric", F.when(F.col("metric") == "view", "val_auc").otherwise(F.col("metric")))
    return TL.best_epochs(TL.epoch_table(h, ["val_auc"]), patience=3)


@query("phase_means", "run:s epoch:l metric:s mean:d", "select run, epoch, metric, avg(value) as mean from history group by all", "history")
def _(spark, sf):
    return TL.phase_means(fx.history(spark, sf))
