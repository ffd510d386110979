"""Areas that polygons of any shape cover in the cells of a lattice, by walking their edges.

An edge is cut where it crosses the lattice.  A piece changes the covered area of its own cell, and by its height
that of all cells to its right; running sums along a row add that up.  So work and exchange are linear
in the edges' pieces and the cells covered: no candidates, no clipping of pairs, and holes are edges like any other, walked the other way round.  The edges
of one large polygon are dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.polygons import following
from ..sources.grid import Axis, Grid

#: Covered shares of a cell below this are rounding.
LEAST_SHARE = 1e-12


def _cut(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of the part, for rows cut in ``count`` parts each."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def walk(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, x: Axis, y: Axis) -> tuple[np.ndarray, ...]:
    """edge, i, j (0-based), area right of the piece within its cell, and its height, for the pieces of edges in a lattice.

    Heights are negative for edges that go up.  What lies left of the lattice counts as its left side; what lies right of it has no cells.
    """
    sign = np.where(y1 > y0, -1.0, 1.0)
    up = y1 > y0
    xa, ya, xb, yb = np.where(up, x0, x1), np.where(up, y0, y1), np.where(up, x1, x0), np.where(up, y1, y0)
    some = np.flatnonzero((yb > ya) & (ya < y.at(y.n)) & (yb > y.at(0)))
    first, last = np.clip(y.find(ya[some]), 0, y.n - 1), np.clip(y.find(yb[some]), 0, y.n - 1)
    of, k = _cut(last - first + 1)
    e, j = some[of], first[of] + k
    low, high = np.maximum(ya[e], y.at(j)), np.minimum(yb[e], y.at(j + 1))
    slope = (xb[e] - xa[e]) / (yb[e] - ya[e])
    left, right = (xa[e] + (v - ya[e]) * slope for v in (low, high))
    left, right = (np.where(v == end, own, found) for v, end, own, found in ((low, ya[e], xa[e], left), (high, yb[e], xb[e], right)))
    left, right, height = np.minimum(left, right), np.maximum(left, right), high - low
    first, last = np.clip(x.find(left), -1, x.n), np.clip(x.find(right), -1, x.n)
    of, k = _cut(np.where(height > 0, last - first + 1, 0))
    i = first[of] + k
    begin = np.where(i <= 0, -np.inf, x.at(np.clip(i, 0, x.n)))
    begin = np.where(i == 0, x.at(0), begin)
    end = np.where(i >= x.n, np.inf, x.at(np.clip(i + 1, 0, x.n)))
    a, b = np.maximum(left[of], begin), np.minimum(right[of], end)
    wide = right[of] - left[of]
    own = np.where(wide > 0, height[of] * np.maximum(b - a, 0) / np.where(wide > 0, wide, 1), np.where(k == 0, height[of], 0.0))
    keep = (i < x.n) & (own > 0)
    of, i, a, b, own = of[keep], i[keep], a[keep], b[keep], own[keep]
    middle = np.where(i < 0, x.at(0), (a + b) / 2)
    i = np.maximum(i, 0)
    own = own * sign[e[of]]
    return e[of], i, j[of], own * (x.at(i + 1) - middle), own


def outline_weights(lattice: Grid, outlines: Grid) -> DataFrame:
    """dst, src, area of the lattice's cells and the polygons (with holes, of any shape) that cover some of them."""
    x, y = lattice.axes

    def edges(ring) -> DataFrame:
        return F.zip_with(ring, following(ring), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))

    def signed(ring):  # counterclockwise: positive
        origin = F.get(ring, F.lit(0))
        return F.aggregate(F.zip_with(ring, following(ring), lambda a, b: (a["x"] - origin["x"]) * (b["y"] - origin["y"]) - (b["x"] - origin["x"]) * (a["y"] - origin["y"])), F.lit(0.0), lambda s, v: s + v)

    cells = outlines.cells.where(~outlines.is_ghost())
    rings = cells.select(F.col("cell_id").alias("src"), "ring", F.lit(1.0).alias("side"))
    if "holes" in cells.columns:
        rings = rings.unionByName(cells.select(F.col("cell_id").alias("src"), F.explode("holes").alias("ring"), F.lit(-1.0).alias("side")))
    # the turn of a ring is found before its edges are parted, else it would be found again for each of them
    turned = rings.select("src", (F.when(signed(F.col("ring")) < 0, -1.0).otherwise(1.0) * F.col("side")).alias("turn"), edges(F.col("ring")).alias("edges"))
    rows = turned.select("src", "turn", F.explode("edges").alias("e")).select("src", "turn", "e.*")
    # a few rings have all edges
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "x0", "y0")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                e, i, j, area, height = walk(*(part.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")), x, y)
                turn = part.column("turn").to_numpy()[e]
                yield pa.RecordBatch.from_arrays([part.column("src").take(pa.array(e)), *map(pa.array, (i, j, area * turn, height * turn))], ["src", "i", "j", "area", "height"])

    cut = rows.mapInArrow(pieces, "src bigint, i bigint, j bigint, area double, height double").groupBy("src", "j", "i").agg(F.sum("area").alias("area"), F.sum("height").alias("height"))
    row = Window.partitionBy("src", "j").orderBy("i")
    before = F.coalesce(F.sum("height").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    run = cut.select("src", "i", "j", "area", before.alias("before"), (before + F.col("height")).alias("after"), F.coalesce(F.lead("i").over(row), F.lit(x.n)).alias("until"))

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, area, before, after, until = (batch.column(c).to_numpy() for c in ("i", "j", "area", "before", "after", "until"))
            tall = y.at(j + 1) - y.at(j)
            of, k = _cut(np.where(np.abs(after) > LEAST_SHARE * tall, until - i, 1))
            at = i[of] + k
            wide = x.at(at + 1) - x.at(at)
            covered = np.where(k == 0, area[of] + before[of] * wide, after[of] * wide)
            keep = covered > LEAST_SHARE * wide * tall[of]
            dst = at + 1 + j[of] * x.n
            yield pa.RecordBatch.from_arrays([pa.array(dst[keep]), batch.column("src").take(pa.array(of[keep])), pa.array(covered[keep])], ["dst", "src", "area"])

    return run.mapInArrow(cells_of, "dst bigint, src bigint, area double")
