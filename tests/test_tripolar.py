"""Tripolar grids: geometry of the cap, the fold, parts with offsets, and regridding across them."""

import numpy as np
import pytest
from meshweave.operators.regridder import build_regridder
from meshweave.sources import latlon_grid, tripolar_grid
from meshweave.sources.grid import part_of
from meshweave.sources.tripolar import fold_sizes, folded_parts
from pyspark.sql import functions as F


def rings(grid):
    return {r.cell_id: np.array([[p.x, p.y, p.z] for p in r.ring]) for r in grid.cells.collect()}


@pytest.mark.parametrize("fold", ["edge", "center"])
def test_cells_tile_the_sphere(spark, fold):
    grid = tripolar_grid(spark, 24, 16, 6, south=-90.0, fold=fold)
    found = rings(grid)
    assert all(np.allclose(np.linalg.norm(r, axis=1), 1) for r in found.values())
    assert np.isclose(grid.areas().agg(F.sum("area")).first()[0], 4 * np.pi, rtol=1e-9)


def test_edge_fold_meets_itself(spark):
    nx, ny = 24, 10
    found = rings(tripolar_grid(spark, nx, ny, 4))
    for i in range(1, nx + 1):
        here, there = found[nx * (ny - 1) + i], found[nx * (ny - 1) + nx + 1 - i]
        assert np.allclose(here[[2, 3]], there[[3, 2]], atol=1e-12)
    poles = found[nx * (ny - 1) + 1][[0, 3]], found[nx * (ny - 1) + nx // 2][[1, 2]]
    for ring, lon in zip(poles, (70.0, 250.0), strict=True):
        assert np.allclose(ring, [np.cos(np.radians(60)) * np.cos(np.radians(lon)), np.cos(np.radians(60)) * np.sin(np.radians(lon)), np.sin(np.radians(60))], atol=1e-12)


def test_rows_and_columns_meet_at_right_angles(spark):
    nx, ny = 720, 60
    found = rings(tripolar_grid(spark, nx, ny, 40))
    for i, j in ((100, 30), (250, 45), (500, 55)):
        r = found[i + (j - 1) * nx]
        a, b = r[1] - r[0], r[3] - r[0]
        assert abs(a @ b) < 0.02 * np.linalg.norm(a) * np.linalg.norm(b)


def test_center_fold_mirrors_cells(spark):
    nx, ny = 16, 8
    grid = tripolar_grid(spark, nx, ny, 4, fold="center")
    found = rings(grid)
    ghosts = {r.cell_id - nx * (ny - 1) for r in grid.cells.where("is_ghost").collect()}
    assert ghosts == {5, 6, 7, 8, 13, 14, 15, 16}
    for i in ghosts:
        assert nx + 1 - i not in ghosts
        assert np.allclose(found[nx * (ny - 1) + i], found[nx * (ny - 1) + nx + 1 - i][[2, 3, 0, 1]], atol=1e-12)


def test_parts_are_the_folded_grid(spark):
    nx, ny = 16, 8
    grid = tripolar_grid(spark, nx, ny, 4, fold="center")
    parts = folded_parts(grid)
    assert parts.n_cells == grid.n_cells
    assert sorted(map(tuple, parts.areas().collect())) == sorted(map(tuple, grid.areas().collect()))
    part, local = part_of(F.col("cell_id"), fold_sizes(nx, ny))
    for row in parts.cells.select("cell_id", "face", part.alias("part"), local.alias("local")).collect():
        start = np.concatenate([[0], np.cumsum(fold_sizes(nx, ny))])[row.face - 1]
        assert (row.part, row.local) == (row.face, row.cell_id - start)
    target = latlon_grid(spark, 8, 4)
    one, other = (sorted((r.dst, r.src, round(r.area, 12)) for r in build_regridder(target, g).weights.collect() if r.area > 1e-10) for g in (parts, grid))
    assert one == other


@pytest.mark.parametrize("fold", ["edge", "center"])
def test_every_cell_is_covered(spark, fold):
    r = build_regridder(latlon_grid(spark, 12, 6), tripolar_grid(spark, 16, 10, 5, south=-90.0, fold=fold))
    dst, src = r.marginals()
    assert np.isclose(dst.agg(F.sum("total")).first()[0], 4 * np.pi, rtol=1e-9)
    for row in src.collect():
        assert np.isclose(row.total, row.area, rtol=1e-7, atol=1e-12)
    for row in dst.collect():
        assert np.isclose(row.total, row.area, rtol=1e-7)


def test_arguments(spark):
    for bad in ((15, 8, 4), (16, 8, 8), (16, 8, 0)):
        with pytest.raises(ValueError):
            tripolar_grid(spark, *bad)
    with pytest.raises(ValueError):
        tripolar_grid(spark, 16, 8, 4, fold="corner")
    with pytest.raises(ValueError):
        tripolar_grid(spark, 18, 8, 4, fold="center")
