"""Overlapping boxes replaced by their hull until none overlap.

Any boxes that overlap end up in one hull, whatever the order, so every subset may be merged on its own first: each task merges the boxes
of a batch, then the boxes of a spatial block, where a box of several blocks is in all of them. The hulls that two blocks make of such a box
overlap in it, so they meet again in the next round, whose blocks are coarser. It is over when no block finds an overlap, or when a group has one block only.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagframe.operators.hot import with_stats
from bagframe.session import cut_lineage

#: Boxes in a block, about, in the first round; each round has blocks of twice as many, up to so many times the first.
BLOCK_BOXES = 20_000
_COARSEST = 64


class Shelves:
    """Boxes that do not overlap, found by place: each is on the grid whose cells are as large as the box or up to twice that, so it touches
    two by two cells at the most; empty grids do not exist."""

    def __init__(self) -> None:
        self.cells: dict[int, dict[tuple[int, int], set[int]]] = defaultdict(lambda: defaultdict(set))
        self.boxes: dict[int, tuple] = {}
        self.next = 0

    @staticmethod
    def _range(box: tuple, size: float) -> tuple[range, range]:
        x0, y0, x1, y1 = box[:4]
        return range(math.floor(x0 / size), math.floor(x1 / size) + 1), range(math.floor(y0 / size), math.floor(y1 / size) + 1)

    def _places(self, box: tuple) -> tuple[int, list[tuple[int, int]]]:
        level = math.frexp(max(box[2] - box[0], box[3] - box[1]))[1]
        across, down = self._range(box, math.ldexp(1.0, level))
        return level, [(i, j) for i in across for j in down]

    def overlapping(self, box: tuple) -> set[int]:
        """Numbers of the boxes that share some area with the box."""
        x0, y0, x1, y1 = box[:4]
        seen: set[int] = set()
        for level, cells in self.cells.items():
            across, down = self._range(box, math.ldexp(1.0, level))
            if len(across) * len(down) <= len(cells):
                near = (cells[c] for c in ((i, j) for i in across for j in down) if c in cells)
            else:                                        # a large box over a fine grid: the occupied cells are fewer
                near = (v for (i, j), v in cells.items() if i in across and j in down)
            for numbers in near:
                seen |= numbers
        return {k for k in seen if max(x0, self.boxes[k][0]) < min(x1, self.boxes[k][2]) and max(y0, self.boxes[k][1]) < min(y1, self.boxes[k][3])}

    def put(self, box: tuple) -> None:
        level, places = self._places(box)
        for c in places:
            self.cells[level][c].add(self.next)
        self.boxes[self.next] = box
        self.next += 1

    def take(self, number: int) -> tuple:
        box = self.boxes.pop(number)
        level, places = self._places(box)
        for c in places:
            self.cells[level][c].discard(number)
            if not self.cells[level][c]:
                del self.cells[level][c]
        if not self.cells[level]:
            del self.cells[level]
        return box


def closure(boxes: list[tuple]) -> list[tuple]:
    """(x0, y0, x1, y1, id, merged) without overlaps: a hull has the smallest id of its boxes and is marked as merged. Boxes without
    area overlap nothing; nor do those with a coordinate that is missing or not finite."""
    shelves, out = Shelves(), []
    for box in boxes:
        if any(c is None or not math.isfinite(c) for c in box[:4]) or box[0] >= box[2] or box[1] >= box[3]:
            out.append(box)
            continue
        while hits := shelves.overlapping(box):
            for k in hits:
                other = shelves.take(k)
                same = other[:5] == box[:5]              # a repeated row is no merge
                box = (min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3]), min(box[4], other[4]),
                       box[5] or other[5] or not same)
        shelves.put(box)
    return out + list(shelves.boxes.values())


_NAMES = ("x0", "y0", "x1", "y1", "id", "merged")


def _merged(batch: pa.RecordBatch | pa.Table, schema: pa.Schema) -> list[pa.RecordBatch]:
    """The closure of every group of a batch."""
    groups: dict = defaultdict(list)
    for row in zip(batch.column("g").to_pylist(), *[batch.column(c).to_pylist() for c in _NAMES]):
        groups[row[0]].append(row[1:])
    found = [(g, *box) for g, boxes in groups.items() for box in closure(boxes)]
    return [pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], schema.field(i).type) for i in range(len(schema))], schema=schema)] if found else []


def merge_boxes(boxes: DataFrame, group: str = "file", id_col: str = "id", block_boxes: int = BLOCK_BOXES) -> DataFrame:
    """Replace strictly overlapping boxes by their hull until none overlap. Boxes are (group, id, row, col, h, w); a hull has the smallest id
    of its boxes. Hulls only grow, so the result does not depend on the order of merging. Equal rows are one box. One count per round comes
    to the driver; rounds are written below the shared folder."""
    x = boxes.select(
        F.col(group).alias("g"), F.col("col").cast("double").alias("x0"), F.col("row").cast("double").alias("y0"),
        (F.col("col") + F.col("w")).cast("double").alias("x1"), (F.col("row") + F.col("h")).cast("double").alias("y1"),
        F.col(id_col).alias("id"), F.lit(False).alias("merged"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _merged(batch, batch.schema)

    def block(found: pa.Table) -> pa.Table:
        found = found.drop_columns(["cx", "cy"])
        return pa.Table.from_batches(_merged(found, found.schema), schema=found.schema)

    x, fill = cut_lineage(x.mapInArrow(near, ddl)), block_boxes
    while True:
        split = not x.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fill).isEmpty()
        dealt = (_dealt(x, fill) if split else x.withColumns({"cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long")})).withColumn("merged", F.lit(False))
        found = dealt.groupBy("g", "cx", "cy").applyInArrow(block, ddl)
        x = cut_lineage(found.groupBy("g", "x0", "y0", "x1", "y1", "id").agg(F.max("merged").alias("merged")).select(*x.columns))
        if not split or x.where("merged").isEmpty():
            return x.select(F.col("g").alias(group), F.col("id").alias(id_col), F.col("y0").alias("row"), F.col("x0").alias("col"),
                            (F.col("y1") - F.col("y0")).alias("h"), (F.col("x1") - F.col("x0")).alias("w"))
        fill = min(2 * fill, _COARSEST * block_boxes)


def _dealt(x: DataFrame, block_boxes: int) -> DataFrame:
    """x with a row per block (cx, cy) that a box touches; a group has about as many blocks as its boxes fill."""
    sized = with_stats(x.withColumn("__k", F.coalesce(F.col("g").cast("string"), F.lit(""))), ["__k"], __n=F.count(F.lit(1)), __l=F.min("x0"), __r=F.max("x1"),
                       __t=F.min("y0"), __b=F.max("y1"))
    blocks = F.ceil(F.sqrt(F.ceil(F.col("__n") / block_boxes)))
    side = F.greatest(F.col("__r") - F.col("__l"), F.col("__b") - F.col("__t"), F.lit(1e-300)) / blocks

    def cells(a: str, b: str, base: str) -> Column:
        known = (blocks > 1) & F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) <= F.col(b))
        return F.when(known, F.sequence(F.floor((F.col(a) - F.col(base)) / side), F.floor((F.col(b) - F.col(base)) / side))).otherwise(F.array(F.lit(0).cast("long")))

    return sized.withColumn("cx", F.explode(cells("x0", "x1", "__l"))).withColumn("cy", F.explode(cells("y0", "y1", "__t"))).select(*x.columns, "cx", "cy")
