"""Extents of groups, space-filling order, and comparison of weights."""

import numpy as np
import pytest
from meshweave.functions import kernels
from meshweave.functions.curves import along_the_curve, hilbert_index, hilbert_point
from meshweave.manifold import sphere
from meshweave.operators import build_regridder
from meshweave.operators.extents import extents_by, merged_cap
from meshweave.operators.metrics import weight_differences
from meshweave.sources import cubed_sphere, latlon_grid, regular_grid
from meshweave.sources.grid import Grid
from pyspark.sql import functions as F

POINT = "struct<x: double, y: double, z: double>"


def test_caps_of_groups_hold_their_cells_and_are_tight(spark):
    grid = cubed_sphere(spark, 4)
    found = {r.face: r.cap for r in extents_by(grid, ["face"]).collect()}
    assert len(found) == 6
    for face, rings in grid.cells.groupBy("face").agg(F.collect_list("ring").alias("r")).collect():
        points = np.array([[(p.x, p.y, p.z) for p in ring] for ring in rings]).reshape(-1, 3)
        far = kernels.angles(np.array([tuple(found[face].center)]), points).max()
        assert far <= found[face].radius <= 1.00011 * far


def test_whole_sphere_null_groups_and_boxes(spark):
    grid = latlon_grid(spark, 8, 4)
    assert extents_by(grid, []).first().cap.radius > np.pi
    some = Grid(grid.cells.withColumn("g", F.when(F.col("j") > 2, 1)), grid.shape, grid.manifold)
    assert {r.g for r in extents_by(some, ["g"]).collect()} == {None, 1}
    flat = regular_grid(spark, [0, 1, 4], [0, 2, 3])
    assert sorted(map(tuple, extents_by(flat, ["i"]).collect())) == [(1, 0, 1, 0, 3), (2, 1, 4, 0, 3)]
    assert extents_by(Grid(grid.cells.limit(0), (0,), sphere()), ["i"]).count() == 0


def test_merged_caps(spark):
    draw = np.random.default_rng(2)
    c = draw.normal(size=(400, 3))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    r = draw.uniform(0, 1.2, 400)
    c[0], r[0], c[1], r[1] = c[2], 0.5, c[2], 0.5  # equal caps, and one within another
    c[4], r[4], r[5] = c[5], 0.1, 0.7
    rows = [(((*map(float, c[k]),), float(r[k])), ((*map(float, c[k + 1]),), float(r[k + 1]))) for k in range(0, 400, 2)]
    table = spark.createDataFrame(rows, f"a struct<center: {POINT}, radius: double>, b struct<center: {POINT}, radius: double>")
    for row in table.select("a", "b", merged_cap(F.col("a"), F.col("b")).alias("m")).collect():
        away = [kernels.angles(np.array([tuple(row.m.center)]), np.array([tuple(x.center)]))[0] for x in (row.a, row.b)]
        between = kernels.angles(np.array([tuple(row.a.center)]), np.array([tuple(row.b.center)]))[0]
        assert all(d + x.radius <= row.m.radius + 1e-9 for d, x in zip(away, (row.a, row.b), strict=True)) or row.m.radius > np.pi
        assert row.m.radius == pytest.approx(min(max(row.a.radius, row.b.radius, (between + row.a.radius + row.b.radius) / 2), np.pi))


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_neighbours_along_the_curve_share_an_edge(spark, bits):
    n = 1 << bits
    points = spark.range(n * n).select(F.pmod("id", F.lit(n)).alias("x"), F.floor(F.col("id") / n).alias("y"))
    found = sorted((r.d, r.x, r.y) for r in points.select("x", "y", hilbert_index(F.col("x"), F.col("y"), bits).alias("d")).collect())
    assert [f[0] for f in found] == list(range(n * n)) and found[0] == (0, 0, 0)
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(found, found[1:], strict=False))
    x, y = hilbert_point(F.col("id"), bits)
    assert [tuple(r) for r in spark.range(n * n).select("id", x, y).orderBy("id").collect()] == found


def test_faces_in_order_of_the_curve(spark):
    grid = cubed_sphere(spark, 4)
    turned = grid.with_ids(along_the_curve(grid, 4))
    assert sorted(r.cell_id for r in turned.cells.collect()) == list(range(1, 97))
    assert {(r.cell_id - 1) // 16 + 1 - r.face for r in turned.cells.collect()} == {0}
    with pytest.raises(ValueError, match="power of two"):
        along_the_curve(grid, 3)


def test_differences_of_weights(spark):
    r = build_regridder(regular_grid(spark, [0, 1, 2], [0, 1]), regular_grid(spark, [0, 0.5, 2], [0, 1]))
    assert weight_differences(r.weights, r.weights).isEmpty()
    other = r.weights.where("src = 2").withColumn("area", F.col("area") * F.when(F.col("dst") == 1, 1 + 1e-6).otherwise(1 + 1e-12))
    assert sorted((d.dst, d.src, d.one > 0, d.other > 0) for d in weight_differences(r.weights, other).collect()) == [(1, 1, True, False), (1, 2, True, True)]
    assert [d.src for d in weight_differences(r.weights, other, relative=1e-3).collect()] == [1]
