from math import pi

import numpy as np
import pytest
from meshweave.functions import fields
from meshweave.functions.quadrature import fan_triangulate, gauss_lobatto, lagrange, planar_triangle_area, reference_rule, spherical_mean
from meshweave.manifold import sphere
from meshweave.operators import build_regridder
from meshweave.operators.candidates import binned_pair
from meshweave.operators.fields import sample
from meshweave.operators.metrics import average_coincident, error_metrics, integral, mirror_fold
from meshweave.sources import corner_grid, cubed_sphere, fold_grid, healpix_grid, latlon_grid, ring_grid, rotated_latlon_grid
from meshweave.sources.grids import healpix_nested_to_ring
from pyspark.sql import functions as F


def column(table, name="area"):
    return np.array([r[name] for r in sorted(table.collect(), key=lambda r: r.cell_id)])


def every_grid(spark):
    return {
        "latlon": latlon_grid(spark, 24, 12),
        "shifted": latlon_grid(spark, 15, 10, lon=(-180.0, 180.0)),
        "rotated": rotated_latlon_grid(spark, 20, 10, (40.0, 60.0)),
        "healpix": healpix_grid(spark, 4),
        "ring": ring_grid(spark, [78.75, 56.25, 33.75, 11.25, -11.25, -33.75, -56.25, -78.75], 16),
        "cubed": cubed_sphere(spark, 5),
    }


def test_grids_cover_the_sphere(spark):
    for name, grid in every_grid(spark).items():
        areas = column(grid.areas())
        assert len(areas) == grid.n_cells and (areas > 0).all() and np.isclose(areas.sum(), 4 * pi, rtol=1e-10), name
    assert np.isclose(column(latlon_grid(spark, 6, 3, radius=2.0).areas()).sum(), 16 * pi)


@pytest.mark.parametrize("pair", [("latlon", "latlon"), ("latlon", "rotated"), ("healpix", "latlon"), ("ring", "cubed"), ("cubed", "healpix"), ("rotated", "shifted")])
def test_pairs_conserve(spark, pair):
    grids = every_grid(spark)
    r = build_regridder(grids[pair[0]], grids[pair[1]]).persist()
    for side in r.marginals():
        assert np.allclose(column(side, "total"), column(side, "area"), rtol=1.5e-8, atol=1e-12)
    value = np.random.default_rng(1).uniform(0, 1, r.n_src)
    field = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(value)], "cell_id long, value double")
    out = r.regrid(field)
    assert np.isclose(integral(out, r.dst_areas).first().integral, integral(field, r.src_areas).first().integral, rtol=1e-8)
    ones = r.regrid(field.withColumn("value", F.lit(1.0)))
    assert np.allclose(column(ones, "value"), 1, atol=1e-7)
    r.unpersist()


def test_bin_rows_do_not_grow_with_the_ratio_of_the_grids(spark):
    coarse, rows = cubed_sphere(spark, 2), []
    for nside in (4, 16):
        a, b = binned_pair(coarse, healpix_grid(spark, nside))
        rows.append((a.count() / 24, b.count() / (12 * nside**2)))
    assert all(max(r) <= 16 for r in rows) and rows[1][0] <= 1.5 * rows[0][0] and rows[1][1] <= 1.5 * rows[0][1]


def test_healpix_orders(spark):
    for nside in (1, 2, 8):
        rows = spark.range(12 * nside**2).select("id", healpix_nested_to_ring(F.col("id"), nside).alias("r")).collect()
        assert sorted(r.r for r in rows) == list(range(12 * nside**2))
        grid = healpix_grid(spark, nside, order="ring")
        z = F.aggregate("ring", F.lit(0.0), lambda s, p: s + p["z"])
        z = [r.z for r in sorted(grid.cells.select("cell_id", z.alias("z")).collect(), key=lambda r: r.cell_id)]
        assert all(a >= b - 1e-9 for a, b in zip(z, z[1:], strict=False))
    for bad in (0, 3):
        with pytest.raises(ValueError):
            healpix_grid(spark, bad)
    with pytest.raises(ValueError):
        ring_grid(spark, [45, -45], [4, 8])


def test_fold_and_mirror(spark):
    grid = fold_grid(latlon_grid(spark, 8, 4))
    areas = column(grid.areas())
    assert (areas[24:] > 0).tolist() == [True, True, False, False, True, True, False, False]
    r = build_regridder(grid, latlon_grid(spark, 4, 2))
    out = r.regrid(spark.createDataFrame([(i, 3.0) for i in range(1, 9)], "cell_id long, value double"))
    assert np.isnan(column(out, "value")[[26, 27, 30, 31]]).all()
    assert np.allclose(column(mirror_fold(out, 8, 4), "value"), 3.0)
    with pytest.raises(ValueError):
        fold_grid(latlon_grid(spark, 6, 4))


def test_corner_points(spark):
    lon, lat = np.linspace(0, 90, 5), np.linspace(0, 45, 4)
    points = np.array([[(a, b) for b in lat] for a in lon])
    got = column(corner_grid(spark, points, manifold=sphere()).areas())
    assert np.allclose(got, column(latlon_grid(spark, 4, 3, lon=(0.0, 90.0), lat=(0.0, 45.0)).areas()))


def test_quadrature():
    from math import factorial as f

    for degree in range(1, 9):
        points, weights = reference_rule(degree)
        assert len(weights) == (1, 3, 4, 6, 7, 12, 13, 16)[degree - 1] and np.isclose(weights.sum(), 0.5, atol=1e-12)
        for a in range(degree + 1):
            for b in range(degree + 1 - a):
                assert np.isclose((weights * points[:, 0] ** a * points[:, 1] ** b).sum(), f(a) * f(b) / f(a + b + 2), atol=1e-10)
    with pytest.raises(ValueError):
        reference_rule(9)
    square = fan_triangulate([(0, 0), (1, 0), (1, 1), (0, 1)])
    assert np.isclose(sum(planar_triangle_area(*t) for t in square), 1) and len(fan_triangulate(np.zeros((2, 2)))) == 0
    for n in range(2, 6):
        x, w = gauss_lobatto(n)
        for k in range(2 * n - 2):
            assert np.isclose((w * x**k).sum(), (1 - (-1) ** (k + 1)) / (k + 1), atol=1e-12)
        assert np.allclose(lagrange(x, x), np.eye(n))
    octant = np.eye(3)
    assert np.isclose(spherical_mean(octant, lambda p: p[:, 2]), 0.5, atol=2e-3) and spherical_mean(octant[[0, 0, 0]], lambda p: p[:, 0]) == 0


def test_fields_and_metrics(spark):
    grids = every_grid(spark)
    src, dst = grids["latlon"], grids["ring"]
    sampled = lambda grid, f: sample(grid, f).data
    r = build_regridder(dst, src).persist()
    for f, most in ((fields.sinusoid_field(), 0.05), (fields.vortex_field(), 0.5), (fields.gulf_stream_field(), 0.1)):
        row = error_metrics(r.regrid(sampled(src, f)), sampled(dst, f)).first()
        assert row.mean_misfit < most and row.rms_misfit <= row.max_misfit
    r.unpersist()
    at = spark.createDataFrame([(0.0, 0.0), (10.0, 45.0)], "lon double, lat double")
    value = lambda f: [r[0] for r in at.select(f(F.col("lon"), F.col("lat"))).collect()]
    assert value(fields.longitude_field()) == [0.0, 10.0]
    assert np.allclose(value(fields.sinusoid_field()), [1.0, 2 - np.cos(np.arccos(np.cos(np.radians(10)) * np.cos(np.radians(45))) / 1.2)])
    assert np.allclose(value(fields.harmonic_field()), [2.0, 2 + np.cos(np.radians(160))])


def test_coincident_nodes_are_averaged(spark):
    nodes = spark.createDataFrame([(1, 7, 2.0, 1.0), (2, 7, 5.0, 3.0), (3, 8, 9.0, 1.0)], "node_id long, global_node long, value double, weight double")
    assert sorted((r.node_id, r.value) for r in average_coincident(nodes).collect()) == [(1, 4.25), (2, 4.25), (3, 9.0)]
