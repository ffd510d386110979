"""Polygons of any shape, by walks along edges and by convex parts, and regions as HEALPix keys."""

import numpy as np
import pytest
from meshweave.functions import kernels
from meshweave.manifold import sphere
from meshweave.operators import build_regridder
from meshweave.operators.candidates import binned_pair, candidate_pairs
from meshweave.operators.outlines import walk
from meshweave.operators.pixels import cap_poles, cover, cover_regions, pixel_caps, pixel_of, points_in_regions, polygon_poles
from meshweave.sources import latlon_grid, polygon_grid, regular_grid
from meshweave.sources.grid import Axis
from meshweave.sources.grids import uniform_grid
from pyspark.sql import functions as F


def star(n, middle, seed, low=0.3, high=1.0):
    draw = np.random.default_rng(seed)
    angle = np.sort(draw.random(n)) * 2 * np.pi
    far = draw.uniform(low, high, n)
    return np.column_stack([middle[0] + far * np.cos(angle), middle[1] + far * np.sin(angle)])


def area(ring):
    x, y = ring.T
    return abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2


def weights(r):
    return {(w.dst, w.src): w.area for w in r.weights.collect()}


SHAPES = [
    star(40, (3.1, 2.2), 1, 0.5, 2.9),
    star(300, (-0.4, 1.0), 2),  # partly left of the lattice
    star(7, (9.0, 9.0), 3)[::-1],  # clockwise, beyond the upper right corner
    {"exterior": star(60, (5.0, 4.0), 4, 1.5, 2.0), "holes": [star(30, (5.0, 4.0), 5, 0.2, 0.7), star(5, (5.9, 4.0), 6, 0.1, 0.15)[::-1]]},
    np.array([(1, 1), (3, 1), (3, 3), (1, 3)]),  # along the lattice's lines
    np.array([(20, 20), (21, 20), (21, 21)]),
]


def test_walked_edges_equal_clipped_parts(spark):
    """The same overlaps by walks on a lattice, by convex parts of its cells as polygons, and by a nested loop; both ways round."""
    x, y = [0, 1, 2.5, 3, 4, 6, 8, 9.1], [0, 0.5, 1, 3, 4, 4.25, 9]
    shapes = polygon_grid(spark, SHAPES)
    boxes = polygon_grid(spark, [[(a, b), (c, b), (c, d), (a, d)] for b, d in zip(y, y[1:], strict=False) for a, c in zip(x, x[1:], strict=False)])
    lattice = regular_grid(spark, x, y)
    walked, clipped = weights(build_regridder(lattice, shapes)), weights(build_regridder(boxes, shapes))
    assert {k for k, v in clipped.items() if v > 1e-9} == {k for k, v in walked.items() if v > 1e-9}
    assert all(walked[k] == pytest.approx(v, abs=1e-9) for k, v in clipped.items() if v > 1e-9)
    back = weights(build_regridder(shapes, lattice))
    assert {(b, a): v for (a, b), v in back.items()} == pytest.approx(walked)
    assert weights(build_regridder(boxes, shapes, nested_loop=True)) == pytest.approx(clipped)


def test_whole_areas_on_a_uniform_lattice(spark):
    shapes = [s for s in SHAPES if not isinstance(s, dict)]
    r = build_regridder(uniform_grid(spark, 300, 310, (-3.0, 21.5), (-2.0, 21.5)), polygon_grid(spark, shapes))
    total = {x.src: x.total for x in r.weights.groupBy("src").agg(F.sum("area").alias("total")).collect()}
    assert total == pytest.approx({k: area(s) for k, s in enumerate(shapes, 1)})
    assert r.weights.groupBy("dst", "src").count().where("count > 1").isEmpty()


def test_pieces_keep_heights():
    draw = np.random.default_rng(0)
    x0, y0, x1, y1 = draw.uniform(-1, 6, (4, 500))
    x, y = Axis([0.0, 0.5, 2, 5.9]), Axis(start=-2.0, step=0.25, n=40)
    edge, i, j, right, height = walk(x0, y0, x1, y1, x, y)
    assert ((i >= 0) & (i < 3) & (j >= 0) & (j < 40)).all()
    inside = np.maximum(np.minimum(np.maximum(x0, x1), 99), 0) < 5.9  # edges with nothing right of the lattice
    assert np.bincount(edge, height, 500)[inside] == pytest.approx((y0 - y1)[inside])
    assert (np.abs(right) <= np.abs(height) * (x.at(i + 1) - x.at(i)) + 1e-12).all()


@pytest.mark.parametrize("seed", range(5))
def test_trapezoids_make_up_the_polygon(seed):
    ring, hole = star(200, (0, 0), seed, 0.5, 1.0), star(50, (0, 0), seed + 9, 0.1, 0.4)
    for rings in ([ring], [ring, hole], [ring[::-1], hole]):
        parts = kernels.trapezoids(rings)
        size = np.full(len(parts), 4)
        assert (kernels.planar_areas(parts, size) >= -1e-12).all()
        assert kernels.planar_areas(parts, size).sum() == pytest.approx(area(ring) - (area(hole) if len(rings) > 1 else 0))
        assert len(parts) <= 2 * sum(map(len, rings))


def on_sphere(flat):
    p = np.column_stack([flat * 0.4, np.ones(len(flat))])[:, [2, 0, 1]]
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def test_non_convex_cells_on_a_sphere(spark):
    """A star in octants and a notch: overlaps add up to the area of the whole cell."""
    star_, notch = on_sphere(star(50, (0, 0), 3)), on_sphere(np.array([(0, 0), (2, -1), (0.5, 0.1), (1, 2.0)]))
    shapes = polygon_grid(spark, [star_, notch], manifold=sphere())
    octants = polygon_grid(spark, [[(a, b), (a + 90, b), (a + 90, b + 89.9), (a, b + 89.9)] for a in (-90, 0) for b in (-89.9, 0)], manifold=sphere())
    r = build_regridder(octants, shapes)
    found = {x.src: x.total for x in r.weights.groupBy("src").agg(F.sum("area").alias("total")).collect()}
    want = {x.cell_id: x.area for x in r.src_areas.collect()}
    assert found == pytest.approx(want, rel=1e-9)
    assert len(kernels.convex_parts(notch, [])) > 1


def random_points(n, seed):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def test_points_lie_in_the_caps_of_their_pixels(spark):
    p = np.concatenate([random_points(2000, 1), [[0, 0, 1], [0, 0, -1], [1, 0, 0], [0, -1, 0]]])
    table = spark.createDataFrame([(i, (*map(float, x),)) for i, x in enumerate(p)], "id int, p struct<x: double, y: double, z: double>")
    for level in (0, 1, 3, 7):
        pix = np.array([r[0] for r in table.orderBy("id").select(pixel_of(F.col("p"), level)).collect()])
        center, radius = pixel_caps(pix, level)
        assert (kernels.angles(center, p) <= radius).all()
        assert pix.min() >= 0 and pix.max() < 12 * 4**level
    every = np.arange(12 * 4**3)
    centers = spark.createDataFrame([(int(i), (*map(float, x),)) for i, x in zip(every, pixel_caps(every, 3)[0], strict=True)], "id int, p struct<x: double, y: double, z: double>")
    assert centers.where(pixel_of(F.col("p"), 3) != F.col("id")).isEmpty()


def test_covers_are_disjoint_and_grow_with_the_border():
    poles, reach = random_points(5, 4)[:, None], np.array([[0.3], [0.02], [1.4], [3.2], [1e-6]])
    sizes = {}
    for depth in (4, 6):
        found = list(cover(poles, reach, depth))
        for k in range(5):
            ranges = sorted((p << 2 * (depth - level), (p + 1) << 2 * (depth - level)) for level, of, pix, _ in found for p in pix[of == k].tolist())
            assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
            sizes[depth, k] = len(ranges)
    assert sizes[6, 3] == 12  # the whole sphere is its twelve faces
    assert sizes[6, 0] < 6 * sizes[4, 0]  # a border has four times the pixels two levels down


@pytest.mark.parametrize("depth", [0, 2, 5])
def test_points_in_caps_and_triangles(spark, depth):
    p, c = random_points(1500, 7), random_points(40, 8)
    point = "struct<x: double, y: double, z: double>"
    points = spark.createDataFrame([(i, (*map(float, x),)) for i, x in enumerate(p)], f"point_id bigint, point {point}")
    reach = np.linspace(0.001, 2.5, 40)
    caps = spark.createDataFrame([(i, (*map(float, x),), float(r)) for i, (x, r) in enumerate(zip(c, reach, strict=True))], f"region_id bigint, c {point}, r double").select("region_id", cap_poles(F.col("c"), F.col("r")).alias("poles"))
    got = {(r.point_id, r.region_id) for r in points_in_regions(points, caps, depth).collect()}
    assert got == {(int(i), int(k)) for i, k in np.argwhere(kernels.angles(p[:, None], c[None]) <= reach)}
    rings = c[:39].reshape(13, 3, 3)
    rings[np.linalg.det(rings) < 0] = rings[np.linalg.det(rings) < 0][:, ::-1]
    table = spark.createDataFrame([(k, [(*map(float, v),) for v in r]) for k, r in enumerate(rings)], f"region_id bigint, ring array<{point}>")
    got = sorted((r.point_id, r.region_id) for r in points_in_regions(points, table.select("region_id", polygon_poles(F.col("ring")).alias("poles")), depth).collect())
    normals = np.cross(rings, np.roll(rings, -1, axis=1))
    assert got == sorted((int(i), int(k)) for i, k in np.argwhere((np.einsum("pd,krd->pkr", p, normals) >= 0).all(axis=2)))


def test_no_regions(spark):
    none = spark.createDataFrame([], "region_id bigint, poles array<struct<x: double, y: double, z: double, reach: double>>")
    assert cover_regions(none, 4).count() == 0


def largest_key(dst, src, **options):
    a, b = binned_pair(dst, src, **options)
    keys = [c for c in a.columns if c in ("level", "depth") or c.startswith("bin")]
    return max(x.groupBy(*keys).count().agg(F.max("count")).first()[0] for x in (a, b))


def test_a_box_over_a_fine_lattice_fills_no_bin(spark):
    """Large boxes over 160,000 cells: no key has 10,000 rows, and each pair is there once."""
    boxes = polygon_grid(spark, [[(a, b), (a + w, b), (a + w, b + w), (a, b + w)] for a, b, w in ((-1, -1, 402), (10.5, 20.5, 300), (399.5, 399.5, 300), (7.25, 7.25, 0.5))])
    fine = uniform_grid(spark, 400, 400, (0.0, 400.0), (0.0, 400.0))
    assert largest_key(boxes, fine, full=10**9) > 100_000
    assert largest_key(boxes, fine) < 10_000
    pairs = candidate_pairs(boxes, fine).select("dst_id", "src_id")
    assert {r[0]: (r[1], r[2]) for r in pairs.groupBy("dst_id").agg(F.count("*"), F.countDistinct("src_id")).collect()} == {1: (160_000, 160_000), 2: (301 * 301,) * 2, 3: (1, 1), 4: (1, 1)}


def test_split_bins_change_no_pair(spark):
    """Clusters of many sizes, on the plane and on a sphere, with identical cells that no split can part."""
    draw = np.random.default_rng(6)
    boxes = [(*draw.normal(0, 1, 2), 10 ** draw.uniform(-1.5, 0.5)) for _ in range(300)] + [(0.1, 0.1, 2.0)] * 40
    one, other = (polygon_grid(spark, [[(a, b), (a + w, b), (a + w, b + w), (a, b + w)] for a, b, w in part]) for part in (boxes[::2], boxes[1::2]))
    plain = sorted(tuple(r) for r in candidate_pairs(one, other, full=10**9).select("dst_id", "src_id").collect())
    for full in (12, 40):
        assert sorted(tuple(r) for r in candidate_pairs(one, other, full=full).select("dst_id", "src_id").collect()) == plain
    coarse, fine = latlon_grid(spark, 2, 3), latlon_grid(spark, 24, 12)
    plain = sorted(tuple(r) for r in candidate_pairs(coarse, fine, full=10**9).select("dst_id", "src_id").collect())
    assert sorted(tuple(r) for r in candidate_pairs(coarse, fine, full=40).select("dst_id", "src_id").collect()) == plain
