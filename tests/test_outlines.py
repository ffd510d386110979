"""Outlines of very many vertices: work and memory grow with the vertices, not with their square."""

import tracemalloc

import numpy as np
import pytest
from meshweave.functions import kernels
from meshweave.plans import shapes

SF = "/root/testdata/sf0.001"


def test_an_outlines_turn_is_found_once_and_not_for_each_edge(spark):
    plan = shapes.outlines_on_lattice(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(edges") < plan.index("aggregate(zip_with(ring")
    assert "REPARTITION_BY_NUM" in plan[: plan.index("Generate explode(edges")]  # edges of a few rings are dealt to all tasks


def profile(n, seed):
    top = np.random.default_rng(seed).uniform(1, 22, n)
    return np.column_stack([np.arange(n) * 0.5, top]), np.trapezoid(top, dx=0.5)


def star(n, seed, low, high):
    draw = np.random.default_rng(seed)
    angle, far = np.sort(draw.random(n)) * 2 * np.pi, draw.uniform(low, high, n)
    return np.column_stack([far * np.cos(angle), far * np.sin(angle)])


@pytest.mark.parametrize("turned", [False, True])
def test_a_long_profile_is_cut_in_memory_for_its_vertices(turned):
    """12,000 vertices whose edges go through 48 million slabs between heights; by abscissas they go through 24,000."""
    top, area = profile(12_000, 1)
    ring = np.concatenate([top, [(top[-1, 0], 0.0), (0.0, 0.0)]])[::-1]
    ring = ring[:, ::-1] if turned else ring
    tracemalloc.start()
    parts = kernels.convex_parts(ring, [])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50e6 and len(parts) <= 12_000
    areas = kernels.planar_areas(np.array(parts), np.full(len(parts), 4))
    assert (areas > 0).all() and areas.sum() == pytest.approx(area)


def test_slabs_a_few_at_a_time_give_the_same_parts(monkeypatch):
    rings = [star(300, 2, 0.5, 1.0), star(80, 3, 0.1, 0.4)]
    whole = kernels.trapezoids(rings)
    monkeypatch.setattr(kernels, "AT_ONCE", 500)
    assert np.array_equal(kernels.trapezoids(rings), whole)


@pytest.mark.parametrize("n", [5, 400])
def test_long_rings_are_judged_as_short_ones(n, monkeypatch):
    circle = np.column_stack([np.cos(np.arange(n) * 2 * np.pi / n), np.sin(np.arange(n) * 2 * np.pi / n)])
    rings, size = kernels.padded(np.array([0, n, 2 * n, 2 * n + 3]), np.concatenate([circle, star(n, 4, 0.5, 1.0), [(0, 0), (2, 0), (0, 3)]]))
    results = []
    for limit in (0, 10**6):
        monkeypatch.setattr(kernels, "LONG", limit)
        results.append((kernels.planar_areas(rings, size), kernels.convex(rings, size)))
    assert results[0][0] == pytest.approx(results[1][0]) and results[0][0][2] == pytest.approx(3)
    assert np.array_equal(results[0][1], results[1][1]) and results[0][1].tolist() == [True, False, True]
