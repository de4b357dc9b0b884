"""Region overlap by the edge index against the test of every pair, and its plan."""

import math
import random
from collections import Counter

import numpy as np

from bagframe.operators import geometry as GE

ANNO = "file string, name string, coords array<struct<x:double,y:double>>, note string"
REGION = "file string, name string, coords array<struct<x:double,y:double>>"


def _shapes(seed, n, size):
    rng, out = random.Random(seed), []
    for i in range(n):
        x, y, kind = rng.randrange(60), rng.randrange(60), rng.randrange(5)
        if kind == 0:
            points = [(x, y)]
        elif kind == 1:
            points = [(x, y), (x + rng.randrange(-size, size), y + rng.randrange(-size, size))]
        elif kind == 2:
            w, h = rng.randrange(1, size), rng.randrange(1, size)
            points = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        else:
            k = rng.randrange(3, 9)
            points = [(x + rng.randrange(-size, size), y + rng.randrange(-size, size)) for _ in range(k)]
        out.append((f"f{i % 2}", f"s{i}", [(float(a), float(b)) for a, b in points]))
    return out


def test_against_every_pair(spark):
    annos = [(*s, "n") for s in _shapes(1, 90, 14)]
    annos += [annos[3], annos[3], (None, "nofile", [(1.0, 1.0)], None), ("f0", "none", None, None), ("f0", "empty", [], None)]
    regions = [r for r in _shapes(2, 40, 30) if len(r[2]) > 2] + [("f1", "all", [(-99.0, -99.0), (200.0, -99.0), (200.0, 200.0), (-99.0, 200.0)])]
    want = Counter((a[0], r[1], a[1]) for a in annos for r in regions if a[0] == r[0] and a[2]
                   and GE.shapes_intersect(np.array(r[2]), np.array(a[2])))
    for cell in (7.0, 64.0, 1024.0):
        found = GE.overlapping(spark.createDataFrame(annos, ANNO), spark.createDataFrame(regions, REGION), cell)
        assert found.columns == ["file", "region", "name", "coords", "note"]
        assert Counter((r.file, r.region, r.name) for r in found.collect()) == want
    assert len(want) > 100


def test_contour_of_many_vertices(spark):
    n = 20_000
    circle = [(1000 + 900 * math.cos(2 * math.pi * k / n), 1000 + 900 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    annos = [("f", "centre", [(1000.0, 1000.0)], None), ("f", "out", [(110.0, 110.0)], None), ("f", "across", [(50.0, 1000.0), (150.0, 1000.0), (100.0, 1010.0)], None),
             ("f", "in", [(900.0, 900.0), (950.0, 900.0), (950.0, 950.0)], None), ("f", "around", [(0.0, 0.0), (2000.0, 0.0), (2000.0, 2000.0), (0.0, 2000.0)], None)]
    found = GE.overlapping(spark.createDataFrame(annos, ANNO), spark.createDataFrame([("f", "circle", circle)], REGION), 64.0)
    assert sorted(r.name for r in found.collect()) == ["across", "around", "centre", "in"]


def test_built_in_functions_only(spark):
    plan = GE.overlapping(spark.createDataFrame([], ANNO), spark.createDataFrame([], REGION))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
