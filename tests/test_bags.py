"""Tiles, bags, encoders and geometry against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagframe.operators import bags as BG
from bagframe.operators import encoders as E
from bagframe.operators import geometry as GE
from bagframe.operators import tiles as TI


def grid(spark, h=6, w=5, dim=3, seed=0, names=("a", "b")):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((len(names), h, w, dim)).astype(np.float32)
    x[:, 0, 1] = 0
    rows = [(n, i, j, x[k, i, j].tolist()) for k, n in enumerate(names) for i in range(h) for j in range(w)]
    return spark.createDataFrame(rows, "name string, i long, j long, feat array<float>"), x


def test_stitched_sparse_is_the_dense_grid(spark):
    df, x = grid(spark)
    shapes = df.groupBy("name").agg((F.max("i") + 1).alias("h"), (F.max("j") + 1).alias("w"))
    dense = TI.stitch(TI.sparse_tiles(df), shapes, 3).collect()
    assert len(dense) == 60
    for r in dense:
        assert np.allclose(r.feat, x["ab".index(r.name), r.i, r.j])


def test_four_quarter_turns_are_the_identity(spark):
    df, _ = grid(spark)
    shapes = df.groupBy("name").agg((F.max("i") + 1).alias("h"), (F.max("j") + 1).alias("w"))
    turned = {k: {(r.name, r.i, r.j): r.feat for r in TI.rotate(df, shapes, k).collect()} for k in range(5)}
    assert turned[4] == turned[0]
    x = {(n, i, j): v for (n, i, j), v in turned[0].items()}
    rot = np.rot90(np.array([[x["a", i, j] for j in range(5)] for i in range(6)]), 1, axes=(0, 1))
    assert all(np.allclose(rot[i, j], turned[1]["a", i, j]) for i in range(5) for j in range(6))


@pytest.mark.parametrize("seed", [0, 1])
def test_background_distance(spark, seed):
    rng = np.random.default_rng(seed)
    t = (rng.random((9, 11)) > 0.15).astype(int)
    t[4, 4] = 0
    df = spark.createDataFrame([("s", i, j, int(t[i, j])) for i in range(9) for j in range(11)], "name string, i long, j long, tissue int")
    bg = np.argwhere(t == 0)
    for r in TI.background_distance(df).collect():
        assert np.isclose(r.distance, np.sqrt(((bg - (r.i, r.j)) ** 2).sum(1).min()))
    m = TI.distance_map(df).agg(F.sum("weight")).first()[0]
    assert np.isclose(m, 1.0)


def test_distance_without_background_is_missing(spark):
    df = spark.createDataFrame([("s", i, j, 1) for i in range(3) for j in range(3)], "name string, i long, j long, tissue int")
    assert TI.background_distance(df).where("distance is not null").count() == 0


def attention(spark, a):
    rows = [("s", 0, int(i), int(j), float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "name string, cls int, i long, j long, a_raw double")


def test_all_background_bag_and_small_bag(spark):
    a = attention(spark, np.full((2, 2), -np.inf))
    assert BG.attention_softmax(a).where("a_soft is not null").count() == 0
    b = attention(spark, np.arange(4.0).reshape(2, 2))
    assert BG.keep_top_k(b, 10).where("a_raw = double('-inf')").count() == 0
    soft = BG.attention_softmax(BG.keep_top_k(b, 2)).orderBy("i", "j").collect()
    assert np.allclose([r.a_soft for r in soft], np.exp([-np.inf, -np.inf, 2, 3]) / np.exp([2, 3]).sum())


def brute_peaks(a, k=3, rounds=10):
    a, low, r = a.copy(), a.min(), k // 2
    h, w = a.shape
    last = np.zeros_like(a)
    for _ in range(rounds):
        peaks = np.zeros_like(a)
        for i in range(h):
            for j in range(w):
                best = max(((a[y, x], -y, -x) for y in range(max(0, i - r), min(h, i + r + 1)) for x in range(max(0, j - r), min(w, j + r + 1))))
                peaks[i, j] = best[1:] == (-i, -j)
        near = np.zeros_like(a)
        for i, j in np.argwhere(peaks):
            near[max(0, i - r):i + r + 1, max(0, j - r):j + r + 1] = 1
        a[(near == 1) & (peaks == 0)] = low
        if (peaks == last).all():
            break
        last = peaks
    return a


def test_peak_suppression(spark):
    a = np.random.default_rng(2).random((6, 7))
    got = np.zeros_like(a)
    for r in BG.suppress_non_peaks(attention(spark, a)).collect():
        got[r.i, r.j] = r.a_raw
    assert np.allclose(got, brute_peaks(a))


def test_bag_vectors_agree(spark):
    df, x = grid(spark)
    att = df.withColumn("cls", F.lit(0)).withColumn("a_soft", (F.col("i") + F.col("j")) / 10.0)
    w = (np.arange(6)[:, None] + np.arange(5)[None]) / 10
    got = {r.name: r.m for r in BG.bag_vectors(att, 3).collect()}
    for k, n in enumerate("ab"):
        assert np.allclose(got[n], (x[k] * w[..., None]).sum((0, 1)), atol=1e-5)


def test_encoders_and_normalisers(spark):
    rng = np.random.default_rng(0)
    px = rng.integers(0, 256, (10, 4 * 4 * 3))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(px)], "id long, pixels array<double>")
    one = E.encode_tiles(df, "constant", (4, 4, 3), batch_size=3).collect()
    assert all(r.feat == [1.0] for r in one) and len(one) == 10
    got = {r.id: r.feat for r in E.encode_tiles(df, "projection", (4, 4, 3), batch_size=4, augment="rot8m", normalise="01", size=5).collect()}
    enc = E.create_encoder("bagframe.operators.encoders.RandomProjection", size=5)
    x = E.Normaliser("01")(px.reshape(10, 4, 4, 3))
    views = []
    for turns in range(4):
        r = np.rot90(x, turns, axes=(1, 2))
        views += [enc(r), enc(r[:, :, ::-1])]
    assert np.allclose([got[i] for i in range(10)], np.mean(views, axis=0), atol=1e-5)
    img = px.reshape(10, 4, 4, 3).astype(np.uint8)
    for name in ("01", "-11", "imagenet", "half"):
        n = E.Normaliser(name)
        assert (n.reverse(n(img)) == img).all()
    with pytest.raises(ValueError):
        E.Normaliser("unknown")


def merge_all(boxes):
    boxes = [list(b) for b in boxes]
    while True:
        for a in range(len(boxes)):
            for b in range(a):
                p, q = boxes[a], boxes[b]
                if max(p[0], q[0]) < min(p[2], q[2]) and max(p[1], q[1]) < min(p[3], q[3]):
                    boxes[b] = [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])]
                    boxes.pop(a)
                    break
            else:
                continue
            break
        else:
            return sorted(map(tuple, boxes))


def test_merged_boxes(spark):
    rng = np.random.default_rng(1)
    raw = [(int(r), int(c), int(h), int(w)) for r, c, h, w in zip(*rng.integers(0, 120, (2, 40)), *rng.integers(2, 22, (2, 40)))]
    want = merge_all([(r, c, r + h, c + w) for r, c, h, w in raw])
    df = spark.createDataFrame([("f", i, *b) for i, b in enumerate(raw)], "file string, id long, row int, col int, h int, w int")
    got = sorted((r.row, r.col, r.row + r.h, r.col + r.w) for r in GE.merge_boxes(df).collect())
    assert got == want


def test_shape_intersection():
    sq = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    assert GE.shapes_intersect(sq, np.array([[5.0, 5.0]]))
    assert not GE.shapes_intersect(sq, np.array([[10.0, 5.0]]))  # a point on the border is not contained
    assert GE.shapes_intersect(sq, sq + 10)  # touching corners
    assert not GE.shapes_intersect(sq, sq + 10.5)
    assert GE.shapes_intersect(sq, np.array([[2, 2], [3, 2], [3, 3]], float))  # inside
    assert GE.shapes_intersect(np.array([[2, 2], [3, 2], [3, 3]], float), sq)  # around


def test_area_centroid_and_units(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)],)], "coords array<struct<x:double,y:double>>")
    r = df.select(GE.polygon_area("coords").alias("a"), GE.centroid("coords").alias("c"),
                  GE.S.px_to_mm2(F.lit(1e6), 1.0).alias("u"), GE.S.px_to_mm2(F.lit(4e6), 0.5).alias("v")).first()
    assert (r.a, r.c.x, r.c.y, r.u, r.v) == (8.0, 2.0, 1.0, 1.0, 1.0)


def test_python_stage_comes_after_the_filter(spark):
    df = spark.createDataFrame([(i, [0.0] * 4, i / 10) for i in range(10)], "id long, pixels array<double>, fraction double")
    plan = E.encode_tiles(TI.keep_tissue(df), "constant", (2, 2, 1))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("Filter")


def test_lower_envelope_of_many_rows():
    rng = np.random.default_rng(4)
    at, first, site, height, ends = [], [0], [], [], [0]
    want = []
    for n in (1, 2, 7, 40, 300, 5, 0, 64):
        p = np.sort(rng.choice(1000, n, replace=False))
        known = rng.random(n) < (0.0 if n == 5 else 0.6)
        h = rng.integers(0, 40, n)[known] ** 2
        at.append(p)
        site.append(p[known])
        height.append(h)
        first.append(first[-1] + n)
        ends.append(ends[-1] + int(known.sum()))
        want += [min(((v - s) ** 2 + g for s, g in zip(p[known], h)), default=-1) for v in p]
    got = TI.lower_envelope(np.concatenate(at), np.array(first), np.concatenate(site), np.concatenate(height), np.array(ends))
    assert got.tolist() == want


def test_envelope_of_a_million_cells():
    n = 1_000_000
    rng = np.random.default_rng(5)
    height = rng.integers(0, 2000, n) ** 2
    height[0] = 0
    d = TI.lower_envelope(np.arange(n), np.array([0, n]), np.arange(n), height, np.array([0, n]))
    for j in rng.integers(0, n, 50):
        a, b = max(0, j - 2000), min(n, j + 2001)
        assert d[j] == ((np.arange(a, b) - j) ** 2 + height[a:b]).min()
