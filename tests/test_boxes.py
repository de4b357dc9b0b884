"""Box merging against a plain loop, in one block and in many, and chains that need one merge after another."""

import random
from collections import Counter

import pytest

from bagframe.operators.boxes import closure, merge_boxes

SCHEMA = "file string, id long, row double, col double, h double, w double"


def _brute(boxes):
    """(x0, y0, x1, y1, id): pairs are merged until none overlap."""
    boxes = list(dict.fromkeys(boxes))
    while True:
        for i, a in enumerate(boxes):
            j = next((j for j in range(i) if max(a[0], boxes[j][0]) < min(a[2], boxes[j][2]) and max(a[1], boxes[j][1]) < min(a[3], boxes[j][3])), None)
            if j is not None:
                b = boxes[j]
                boxes = [c for k, c in enumerate(boxes) if k not in (i, j)] + [(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), min(a[4], b[4]))]
                break
        else:
            return sorted(boxes)


def _boxes(seed, n, reach, side):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.randrange(reach), rng.randrange(reach)
        out.append((float(x), float(y), float(x + rng.randrange(side)), float(y + rng.randrange(side)), i))
    return out


@pytest.mark.parametrize("seed,n,reach,side", [(1, 60, 60, 8), (2, 120, 400, 25), (3, 40, 20, 12), (4, 150, 1000, 60), (5, 80, 300, 3)])
def test_closure_against_pairs(seed, n, reach, side):
    boxes = _boxes(seed, n, reach, side)
    assert sorted(b[:5] for b in closure([(*b, False) for b in boxes])) == _brute(boxes)


def _spiral(n):
    """Boxes of which each overlaps only the hull of all before it."""
    out, x0, y0, x1, y1 = [], 0.0, 0.0, 10.0, 10.0
    out.append((x0, y0, x1, y1))
    for k in range(n - 1):
        side = k % 4
        if side == 0:
            new = (x1 - 1, y1 - 1, x1 + 1, y1 + 1)
        elif side == 1:
            new = (x0 - 1, y1 - 1, x0 + 1, y1 + 1)
        elif side == 2:
            new = (x0 - 1, y0 - 1, x0 + 1, y0 + 1)
        else:
            new = (x1 - 1, y0 - 1, x1 + 1, y0 + 1)
        out.append(new)
        x0, y0, x1, y1 = min(x0, new[0]), min(y0, new[1]), max(x1, new[2]), max(y1, new[3])
    return out, (x0, y0, x1, y1)


def test_spiral_of_500_nested_hulls(spark):
    boxes, hull = _spiral(500)
    order = list(enumerate(boxes))
    random.Random(3).shuffle(order)
    assert [b[:5] for b in closure([(*b, i, False) for i, b in order])] == [(*hull, 0)]
    rows = [("s", i, b[1], b[0], b[3] - b[1], b[2] - b[0]) for i, b in order]
    found = merge_boxes(spark.createDataFrame(rows, SCHEMA).repartition(5), block_boxes=60).collect()
    assert [(r.id, r.col, r.row, r.col + r.w, r.row + r.h) for r in found] == [(0, *hull)]


def test_many_blocks_null_groups_and_flat_boxes(spark):
    data = {"a": _boxes(7, 220, 600, 40), "b": _boxes(8, 60, 90, 9), None: _boxes(9, 30, 60, 12)}
    rows = [(f, b[4], b[1], b[0], b[3] - b[1], b[2] - b[0]) for f, boxes in data.items() for b in boxes]
    rows += rows[:30]
    want = Counter((f, *b) for f, boxes in data.items() for b in _brute(boxes))
    for size in (20_000, 25):
        found = merge_boxes(spark.createDataFrame(rows, SCHEMA).repartition(6), block_boxes=size).collect()
        assert Counter((r.file, r.col, r.row, r.col + r.w, r.row + r.h, r.id) for r in found) == want
    odd = [("c", 1, None, 0.0, 1.0, 1.0), ("c", 2, 0.0, 0.0, float("inf"), 1.0), ("c", 3, 0.0, 0.0, 1.0, 1.0)]
    assert merge_boxes(spark.createDataFrame(odd, SCHEMA)).count() == 3
    assert merge_boxes(spark.createDataFrame([], SCHEMA)).count() == 0
