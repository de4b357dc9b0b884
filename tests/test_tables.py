"""Cohort tables, joins, splits, sources and errors."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from bagframe.functions import scalars as S
from bagframe.operators import balance as BA
from bagframe.operators import cohort as C
from bagframe.operators import joins as J
from bagframe.operators import matching as MA
from bagframe.operators import predict as P
from bagframe.operators import profile as PR
from bagframe.operators import splits as SP
from bagframe.operators.groups import category_groups
from bagframe.operators.spec import CohortSpec, TrainType
from bagframe.plans import fixtures as fx
from bagframe.session import scratch_path
from bagframe.sources import cohorts as SC
from bagframe.sources import inventory as IN

BINARY = CohortSpec(TrainType.CLF, ("Neg", "Pos"))


def test_inner_and_anti_rows_make_the_left_table(spark, sf):
    docs, lab = fx.table(spark, sf, "documents"), fx.table(spark, sf, "labels")
    merged, lo, ro = J.merge_check(docs, lab, "doc_id")
    assert merged.count() + lo.count() == docs.count() and ro.count() == 0


def test_merge_checks_raise(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "name string, v int")
    b = spark.createDataFrame([("x", 1), ("x", 2)], "name string, w int")
    with pytest.raises(ValueError):
        J.merge(a, b.where("w = 1"), "name", check="left")
    assert J.merge(a, b, "name", check="right").count() == 2
    with pytest.raises(ValueError, match="duplicate columns"):
        J.strict_merge(a, a, BINARY)
    with pytest.raises(ValueError, match="after merging"):
        J.strict_merge(a, b.where("w = 1"), BINARY)
    with pytest.raises(ValueError, match="duplicate bag"):
        J.attach_bags(a, BINARY, b)


def test_prefix_match_errors(spark):
    names = spark.createDataFrame([("s1",), ("s2",)], "name string")
    files = spark.createDataFrame([("/m/s1_a.tif",), ("/m/s1_bb.tif",)], "path string")
    short = {r.name: r.path for r in MA.match_paths(names, files, "name", take_shortest=True).collect()}
    assert short == {"s1": "/m/s1_a.tif", "s2": None}
    with pytest.raises(Exception, match="too many files"):
        MA.match_paths(names, files, "name").collect()
    with pytest.raises(Exception, match="no match"):
        MA.match_paths(names, files, "name", take_shortest=True, missing="error").collect()


@pytest.mark.parametrize("k", [3, 5])
def test_fold_rules(spark, sf, k):
    c = fx.cohort(spark, sf)
    folds = SP.cv_folds(c, BINARY, k)
    assert SP.fold_violations(SP.fold_tables(folds, k, BINARY), BINARY, k).count() == 0
    assert SP.fold_violations(SP.rotating_tables(folds, k, BINARY), BINARY, k, test="testing").count() == 0
    sizes = [r["n"] for r in folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == k
    per = folds.groupBy("Pos", "fold").count().groupBy("Pos").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 1 for r in per)


def test_nested_folds_cover_everything(spark, sf):
    c = fx.cohort(spark, sf)
    n = SP.nested_folds(c, BINARY, 3)
    assert n.count() == 9 * c.count()
    tests = n.where("split = 'testing'").groupBy("name").agg(F.count_distinct("outer").alias("o")).collect()
    assert all(r.o == 1 for r in tests)


def test_weighted_sample_follows_the_weights(spark):
    df = spark.createDataFrame([(f"n{i}", w) for i, w in enumerate([1.0, 0.0, 3.0, 6.0])], "name string, w double")
    got = {r.name: r["count"] for r in BA.weighted_sample(df, "w", "name", 4000).groupBy("name").count().collect()}
    assert sum(got.values()) == 4000 and "n1" not in got
    for name, share in (("n0", 0.1), ("n2", 0.3), ("n3", 0.6)):
        assert abs(got[name] / 4000 - share) < 0.03


def test_duplicates_and_unique_values(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "k string, v int")
    assert {r.v for r in PR.duplicates(df, "k").collect()} == {1, 2}
    with pytest.raises(ValueError):
        PR.duplicates(df, "k", error=True)
    with pytest.raises(Exception, match="more than one value"):
        df.groupBy("k").agg(PR.unique_one("v")).collect()


def test_ensemble_size_is_checked(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.3), ("b", 0, 0.2)], "name string, member int, out0 double")
    with pytest.raises(Exception, match="does not have 2 members"):
        P.ensemble_predictions(df, n_members=2).collect()
    with pytest.raises(Exception, match="same number"):
        P.ensemble_attention(df.select("name", "member", F.lit(0).alias("cls"), F.lit(0).alias("i"), F.lit(0).alias("j"),
                                       F.col("out0").alias("a_raw"))).collect()


def test_category_groups_need_every_class(spark):
    rows = [("n1", "a", 1, 0), ("n2", "b", 0, 1), ("n3", "c", 1, 0), ("n4", "c", 0, 1), ("n5", None, 0, 1)]
    df = spark.createDataFrame(rows, "name string, category string, Neg int, Pos int")
    def groups(df, spec, **options):
        found = {}
        for r in category_groups(df, spec, **options).collect():
            found.setdefault(r.category_group, set()).add(r.category)
        return {(k, tuple(sorted(v))) for k, v in found.items()}

    assert groups(df, BINARY) == {("c", ("c",)), ("a_b", ("a", "b")), ("a_c", ("a", "c")), ("b_c", ("b", "c"))}
    assert groups(df, BINARY, sizes=(1,)) == {("c", ("c",))}
    assert groups(df, BINARY, sizes=(2,)) == {("a_b", ("a", "b")), ("a_c", ("a", "c")), ("b_c", ("b", "c"))}
    one = df.where("category = 'c'")
    assert groups(one, BINARY) == groups(one, BINARY, sizes=(1,)) == {("c", ("c",))}


def test_category_groups_with_many_classes_and_categories(spark):
    """64 classes in 21 categories; two categories share a class, each pair with the rest makes a group."""
    classes = tuple(f"c{k}" for k in range(64))
    rows = [(f"k{k % 21:02d}", *[int(j == k) for j in range(64)]) for k in range(64)]
    rows.append(("k00", *[1] * 64))
    df = spark.createDataFrame(rows, "category string, " + ", ".join(f"{c} int" for c in classes))
    spec = CohortSpec(TrainType.CLF, classes)
    assert category_groups(df, spec, sizes=(1,)).count() == 1
    assert category_groups(df, spec, sizes=(2,)).select("category_group").distinct().count() == 20


def test_targets_are_inferred(spark):
    ints = spark.createDataFrame([(4,), (5,), (6,)], "y int")
    assert C.infer_targets(ints, "y")[0] is TrainType.CLF
    with pytest.raises(ValueError, match="bad ordering"):
        C.infer_targets(spark.createDataFrame([(1,), (3,)], "y int"), "y")
    assert C.infer_targets(spark.createDataFrame([(1.5,), (3.0,)], "y double"), "y")[0] is TrainType.REGR
    kind, df, n = C.infer_targets(spark.createDataFrame([([0, 2],), ([1],)], "y array<int>"), "y")
    assert kind is TrainType.MULTILABEL and n == 3 and [tuple(r)[1:] for r in df.collect()] == [(1, 0, 1), (0, 1, 0)]
    assert C.infer_targets(spark.createDataFrame([([0.5, 2.0],), ([1.0, 1.0],)], "y array<double>"), "y")[0] is TrainType.REGR
    with pytest.raises(ValueError, match="different numbers"):
        C.infer_targets(spark.createDataFrame([([0.5, 2.0],), ([1.5],)], "y array<double>"), "y")


def test_missing_values_are_counted_in_the_same_pass(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    obs = Observation()
    kept = C.drop_missing(df, ["v"], obs).collect()
    assert len(kept) == 1 and obs.get == {"total": 3, "kept": 1}
    assert C.rows_with_missing(df).count() == 2


def test_parsing(spark):
    df = spark.createDataFrame([("4", "0.5", "true", "false")], "a string, b string, c string, d string")
    r = df.select(S.parse_number("a"), S.parse_number("b"), S.parse_boolean("c"), S.parse_boolean("d"), S.parse_boolean("a")).first()
    assert tuple(r) == (4.0, 0.5, True, False, None)


def test_require_finite_raises(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "v double")
    with pytest.raises(Exception, match="nan or inf"):
        df.select(S.require_finite("v")).collect()


def test_columns_that_become_equal_are_an_error(spark):
    with pytest.raises(ValueError):
        C.normalise_columns(spark.createDataFrame([(1, 2)], "`A b` int, a_b int"))


def test_duplicate_file_names_are_an_error(spark):
    df = spark.createDataFrame([("x", "/a/x.tif"), ("x", "/b/x.tif")], "name string, path string")
    with pytest.raises(ValueError, match="not unique"):
        IN.unique_names(df)


def test_save_refuses_to_overwrite(spark):
    path = scratch_path(spark, "t")
    SC.save_table(spark.range(3), path)
    with pytest.raises(Exception, match="(?i)already exists"):
        SC.save_table(spark.range(5), path)
    SC.save_table(spark.range(5), path, overwrite=True)
    assert spark.read.parquet(path).count() == 5


def test_row_order_of_positions_is_a_permutation(spark):
    from bagframe.operators.scan import hash_position

    df = spark.range(500).withColumn("g", F.col("id") % 3)
    for blocks in (1, 7):
        rows = hash_position(df, ["g"], ["id"], blocks=blocks).collect()
        for g in range(3):
            pos = sorted(r.pos for r in rows if r.g == g)
            assert pos == list(range(len(pos)))
    a = {r.id: r.pos for r in hash_position(df, ["g"], ["id"], blocks=1).collect()}
    assert a == {r.id: r.pos for r in rows}


def test_balanced_folds_beat_the_average(spark, sf):
    c = fx.cohort(spark, sf)

    def score(f):
        out = []
        for r in f.groupBy("fold").agg(F.collect_list("n_chars").alias("v")).collect():
            x = np.array(r.v, float)
            out.append((np.sqrt(len(x)) - x.sum() / np.linalg.norm(x)) / (np.sqrt(len(x)) - 1))
        return np.mean(out)

    best = score(SP.balanced_folds(c, BINARY, ["n_chars"], 3, iterations=15))
    others = [score(SP.cv_folds(c, BINARY, 3, seed=s)) for s in range(3)]
    assert best <= np.mean(others) + 1e-9


def test_surpluses_keep_duplicates_and_sort_nothing(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")] + [(9, "hot")] * 50, "key long, v string")
    right = spark.createDataFrame([(1,)] * 20 + [(3,), (3,), (None,)], "key long")
    both, only_left, only_right = C.surpluses(left, right, "key")
    assert sorted(r.v for r in both.collect()) == ["a", "b"]
    assert sorted(r.v for r in only_left.collect()) == ["c", "d"] + ["hot"] * 50
    assert sorted((r.key for r in only_right.collect()), key=str) == [3, 3, None]
    # a merge join sorts all rows of both lists in its tasks, a broadcast holds a whole list
    for d in (both, only_left, only_right):
        plan = d._jdf.queryExecution().sparkPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort " not in plan and "Broadcast" not in plan
