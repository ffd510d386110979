"""Chains and products of regridders, fields of other kinds, halos, and bilinear elements."""

import numpy as np
import pytest
from meshweave.operators import build_regridder
from meshweave.operators.chains import AnyRegridder, Chain, ListField, WideField, product, regrid_field
from meshweave.operators.elements import bilinear_coordinates, bilinear_point, located
from meshweave.operators.fields import interior, with_halo
from meshweave.sources import cubed_sphere, regular_grid


@pytest.fixture(scope="module")
def pair(spark):
    a, b, c = (regular_grid(spark, x, [0, 1]) for x in ([0, 1, 2, 3, 4], [0, 1.5, 4], [-1, 0, 3, 5]))
    return build_regridder(b, a).persist(), build_regridder(c, b).persist()


def values(df, *keys):
    return {tuple(r[k] for k in ("cell_id", *keys)): r.value for r in df.collect()}


def test_a_chain_and_a_product_are_two_steps(spark, pair):
    first, second = pair
    field = spark.createDataFrame([(k, t, float(k * t)) for k in range(1, 5) for t in (1, 3)], "cell_id bigint, t int, value double")
    want = values(second.regrid(first.regrid(field, by="t"), by="t"), "t")
    assert isinstance(first, AnyRegridder)
    assert values(Chain(first, second).regrid(field, by="t"), "t") == pytest.approx(want)
    both = product(second, first)
    assert both.shape == (3, 4) and values(both.regrid(field, by="t"), "t") == pytest.approx(want)
    with pytest.raises(ValueError, match="come out"):
        product(first, second)


def test_fields_of_other_kinds(spark, pair):
    first, _ = pair
    wide = WideField(spark.createDataFrame([(k, float(k), -2.0 * k) for k in range(1, 5)], "pixel bigint, a double, b double"), "pixel")
    out = regrid_field(first, wide)
    assert out.data.columns == ["pixel", "a", "b"] and all(r.b == pytest.approx(-2 * r.a) for r in out.data.collect())
    lists = ListField(spark.createDataFrame([(k, [float(k), 1.0]) for k in range(1, 5)], "cell_id bigint, values array<double>"))
    rows = {r.cell_id: r["values"] for r in regrid_field(first, lists).data.collect()}
    assert rows == {r.pixel: pytest.approx([r.a, 1.0]) for r in out.data.collect()}


@pytest.mark.parametrize("y", ["none", "periodic", "fold"])
def test_halo_there_and_back(spark, y):
    nx, ny, halo = 6, 5, 2
    field = spark.createDataFrame([(k, k * 10) for k in range(1, nx * ny + 1)], "cell_id bigint, value int")
    out = {(r.i, r.j): r.value for r in with_halo(field, (nx, ny), halo, y=y).collect()}
    for i in range(1 - halo, nx + halo + 1):
        for j in range(1 - halo, ny + halo + 1):
            a, b = (i - 1) % nx + 1, j
            if not 1 <= j <= ny:
                if y == "none" or (y == "fold" and j < 1):
                    assert (i + halo, j + halo) not in out
                    continue
                a, b = (a, (j - 1) % ny + 1) if y == "periodic" else (nx + 1 - a, 2 * ny - j)
            assert out[i + halo, j + halo] == 10 * (a + (b - 1) * nx)
    back = interior(with_halo(field, (nx, ny), halo, y=y), (nx, ny), halo)
    assert sorted(map(tuple, back.select("cell_id", "value").collect())) == sorted(map(tuple, field.collect()))
    with pytest.raises(ValueError, match="narrower"):
        with_halo(field, (nx, ny), 5)


@pytest.mark.parametrize("dims", [2, 3])
def test_inverse_of_the_bilinear_map(dims):
    draw = np.random.default_rng(dims)
    flat = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)]) + draw.uniform(-0.35, 0.35, (3000, 4, 2))
    xi, eta = draw.uniform(-1.1, 1.1, (2, 3000))
    corners = flat
    if dims == 3:
        corners = np.concatenate([flat * 0.3, np.ones((3000, 4, 1))], axis=2)
        corners /= np.linalg.norm(corners, axis=2, keepdims=True)
    points = bilinear_point(corners, xi, eta)
    if dims == 3:
        points /= np.linalg.norm(points, axis=1, keepdims=True)
    got = bilinear_coordinates(corners, points)
    assert np.allclose(got[0], xi, atol=1e-9) and np.allclose(got[1], eta, atol=1e-9)


def test_no_convergence_is_nan():
    flat = np.array([[(0, 0), (1, 0), (2, 0), (3, 0.0)]])  # no area: no point off the line
    xi, eta = bilinear_coordinates(flat, np.array([[0.5, 4.0]]))
    assert np.isnan(xi).all() and np.isnan(eta).all()


def test_centers_of_elements_of_a_cube(spark):
    grid = cubed_sphere(spark, 3)
    rows = [(c.cell_id, np.array([tuple(p) for p in c.ring]).sum(axis=0)) for c in grid.cells.collect()]
    points = spark.createDataFrame([(k, k, (*map(float, p / np.linalg.norm(p)),)) for k, p in rows], "point_id bigint, elem_id bigint, point struct<x: double, y: double, z: double>")
    found = located(points, grid).collect()
    assert len(found) == 54 and all(abs(r.xi) < 1e-9 and abs(r.eta) < 1e-9 for r in found)
