import numpy as np
import pytest
from meshweave.manifold import PLANAR, common_manifold, sphere
from meshweave.operators import build_regridder
from meshweave.operators.candidates import all_pairs, candidate_pairs
from meshweave.operators.metrics import error_metrics, integral
from meshweave.operators.regridder import Regridder
from meshweave.sources import as_grid, corner_grid, polygon_grid, regular_grid, union_grids
from meshweave.sources.weights_io import load_attrs, load_regridder, save_esmf_weights

#: A rectangle of 3 x 2 in strips, and in two triangles and two squares.
STRIPS = [[(k, 0), (k + 1, 0), (k + 1, 2), (k, 2), (k, 0)] for k in range(3)]
PARTS = [[(0, 0), (2, 2), (0, 2), (0, 0)], [(0, 0), (2, 0), (2, 2), (0, 0)], [(2, 0), (3, 0), (3, 1), (2, 1), (2, 0)], [(3, 2), (2, 2), (2, 1), (3, 1), (3, 2)]]
OVERLAPS = np.array([[1.5, 0.5, 0, 0], [0.5, 1.5, 0, 0], [0, 0, 1, 1]])


def dense(r):
    out = np.zeros(r.shape)
    for w in r.weights.collect():
        out[w.dst - 1, w.src - 1] += w.area
    return out


def column(table, name="area"):
    return np.array([r[name] for r in sorted(table.collect(), key=lambda r: r.cell_id)])


@pytest.fixture(scope="module")
def small(spark):
    return build_regridder(polygon_grid(spark, STRIPS), polygon_grid(spark, PARTS)).persist()


def test_weights_of_polygons(small):
    assert np.allclose(dense(small), OVERLAPS)
    assert column(small.src_areas).tolist() == [2.0, 2.0, 1.0, 1.0] and column(small.dst_areas).tolist() == [2.0] * 3
    assert small.shape == (3, 4) and small.size(2) == 4 and "3×4" in repr(small)


def test_transpose_conserves(small, spark):
    field = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 5, 0, 0], 1)], "cell_id long, value double")
    there = small.regrid(field)
    assert integral(there, small.dst_areas).first().integral == 10.0
    back = small.transpose().regrid(there)
    assert integral(back, small.src_areas).first().integral == 10.0


def test_normalized_weights_give_the_same_field(small, spark):
    scaled = small.normalize()
    assert np.allclose(dense(scaled), OVERLAPS / 1.5)
    array = np.arange(4.0)
    assert np.allclose(scaled.regrid_array(array), small.regrid_array(array))
    assert np.allclose(small.regrid_array(array, normalize=False), OVERLAPS @ array)


def test_arrays_of_any_shape_and_errors(small):
    array = np.random.default_rng(0).normal(size=(3, 4, 2))
    got = small.regrid_array(array, dims=2)
    assert got.shape == (3, 3, 2) and np.allclose(got, np.einsum("ds,asb->adb", OVERLAPS / 2, array))
    for bad, dims in ((array, 4), (array, 0), (array, 1)):
        with pytest.raises(ValueError):
            small.regrid_array(bad, dims=dims)
    with pytest.raises(TypeError):
        small.regrid_array([1, 2])
    with pytest.raises(ValueError):
        small.regrid(small.dst_areas)


def test_uncovered_partly_covered_ghost_and_nan(spark):
    src = regular_grid(spark, [0, 1, 2], [0, 1])
    dst = regular_grid(spark, [0, 1, 3, 4, 5], [0, 1])
    r = build_regridder(dst, src)
    field = spark.createDataFrame([(1, 7.0), (2, 7.0)], "cell_id long, value double")
    assert column(r.regrid(field), "value").tolist() == [7.0, 3.5, 0.0, 0.0]
    with_nan = spark.createDataFrame([(1, float("nan")), (2, None)], "cell_id long, value double")
    assert np.array_equal(column(r.regrid(with_nan), "value"), [float("nan"), 0, 0, 0], equal_nan=True)
    flat = Regridder(r.weights, r.dst_areas.selectExpr("cell_id", "0D as area"), r.src_areas, 4, 2, PLANAR)
    assert np.isnan(column(flat.regrid(field), "value")).all()
    dst_side, src_side = r.marginals()
    assert column(dst_side, "frac").tolist() == [1, 0.5, 0, 0] and column(src_side, "frac").tolist() == [1, 1]
    assert sorted(x.cell_id for x in r.covered().collect()) == [1, 2]


def test_by_columns_complete_every_group(spark):
    r = build_regridder(regular_grid(spark, [0, 2, 4], [0, 1]), regular_grid(spark, [0, 1, 2], [0, 1]))
    field = spark.createDataFrame([(1, "a", 1.0, 5), (2, "a", 3.0, 5), (1, None, 8.0, 1)], "cell_id long, t string, value double, extra int")
    got = {(x.t, x.cell_id): (x.value, x.extra) for x in r.regrid(field, values=["value", "extra"], by="t").collect()}
    assert got == {("a", 1): (2.0, 5.0), ("a", 2): (0.0, 0.0), (None, 1): (4.0, 0.5), (None, 2): (0.0, 0.0)}


def test_custom_operator(spark):
    squares = lambda n: polygon_grid(spark, [[(0, 0), (1, 0), (1, 1), (0, 1)]] * n)
    r = build_regridder(squares(3), squares(2), operator=lambda s, d: 2.5)
    assert dense(r).tolist() == [[2.5, 2.5]] * 3
    assert build_regridder(squares(3), squares(2), operator=lambda s, d: -1.0).weights.count() == 0


def test_holes_and_non_convex_cells(spark):
    ell = [(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)]
    frame = {"exterior": [(0, 0), (4, 0), (4, 4), (0, 4)], "holes": [[(1, 1), (3, 1), (3, 3), (1, 3)]]}
    a = polygon_grid(spark, [ell, frame])
    b = polygon_grid(spark, [[(0.5, 0.5), (2, 0.5), (2, 2), (0.5, 2)], ell, frame])
    assert column(a.areas()).tolist() == [5.0, 12.0]
    got = dense(build_regridder(a, b))
    assert np.allclose(got, [[1.25, 5.0, 5.0], [1.25, 5.0, 12.0]])


@pytest.mark.parametrize("width", [0.07, 0.3, 2.0, None])
def test_binned_candidates_equal_the_nested_loop(spark, width):
    rng = np.random.default_rng(5)
    grids = []
    for n in (60, 80):
        low = rng.uniform(-1, 1, (n, 2))
        size = rng.uniform(0.01, 0.5, (n, 2))
        grids.append(polygon_grid(spark, [[(x, y), (x + a, y), (x + a, y + b), (x, y + b)] for (x, y), (a, b) in zip(low, size, strict=True)]))
    pairs = lambda df: sorted((r.dst_id, r.src_id) for r in df.collect())
    assert pairs(candidate_pairs(*grids, width=width)) == pairs(all_pairs(*grids))


def test_no_nested_loop_in_the_plan(spark):
    a = regular_grid(spark, list(range(9)), list(range(9)))
    plan = build_regridder(a, a).weights._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "MapInArrow" not in plan


def test_polygon_kernel_equals_rectangles(spark):
    x, y = np.array([0, 0.3, 1.1, 2.0]), np.array([0, 0.5, 1.7])
    regular = regular_grid(spark, x, y)
    corners = corner_grid(spark, np.array([[(a, b) for b in y] for a in x]))
    other = regular_grid(spark, [0, 0.9, 2.0], [0, 1.0, 1.7])
    assert regular.shape == corners.shape == (3, 2)
    assert np.allclose(column(regular.areas()), column(corners.areas()))
    assert np.allclose(dense(build_regridder(other, regular)), dense(build_regridder(other, corners)))


def test_cells_unions_and_permutations(spark):
    g = regular_grid(spark, [0, 1, 2, 3], [0, 1, 2])
    assert g.cell(2, 2).first().cell_id == 5 and g.ncells(1) == 3 and g.n_cells == 6
    for bad in ((0,), (7,), (4, 1)):
        with pytest.raises(IndexError):
            g.cell(*bad)
    both = union_grids([g, regular_grid(spark, [3, 4], [0, 2])])
    assert both.n_cells == 7 and column(both.areas()).tolist() == [1.0] * 6 + [2.0]
    order = spark.createDataFrame([(i, 7 - i) for i in range(1, 7)], "cell_id long, new_id long")
    assert g.with_ids(order).cell(6).first().ring == g.cell(1).first().ring


def test_manifolds_and_unknown_grids(spark):
    assert common_manifold(PLANAR, sphere()) == sphere() and common_manifold(sphere(2), sphere(2)) == sphere(2)
    for a, b in ((sphere(2), sphere()), (PLANAR, sphere(2))):
        with pytest.raises(ValueError):
            common_manifold(a, b)
    for bad in (3, "grid", [1, 2], np.zeros(3)):
        with pytest.raises(TypeError):
            as_grid(bad, spark)
    assert as_grid(([0, 1], [0, 1, 2]), spark).shape == (1, 2)


def test_a_failing_operator_names_both_cells(spark):
    def broken(src, dst):
        raise RuntimeError("no area")

    r = build_regridder(regular_grid(spark, [0, 1], [0, 1]), regular_grid(spark, [0, 1], [0, 1]), operator=broken)
    with pytest.raises(Exception, match="source cell 1 and destination cell 1"):
        r.weights.collect()


def test_areas_of_zero_divide_nothing(spark):
    flat = spark.createDataFrame([(1, 0.0)], "cell_id long, area double")
    field = spark.createDataFrame([(1, 0.0)], "cell_id long, value double")
    assert np.isnan(integral(field, flat).first()["mean"]) and np.isnan(error_metrics(field, field).first()["l_min"])


def test_weights_round_trip(small, spark, tmp_path):
    path = save_esmf_weights(str(tmp_path / "deep" / "w"), small, src_grid_name="parts")
    again = load_regridder(spark, path)
    assert np.allclose(dense(again), OVERLAPS) and again.shape == (3, 4)
    attrs = load_attrs(spark, path)
    assert attrs["normalization"] == "destarea" and attrs["src_grid_name"] == "parts" and attrs["dst_grid_name"] == "destination" and "src_shape" not in attrs
    assert np.allclose(column(spark.read.parquet(f"{path}/dst"), "frac_b"), 1)


def test_stream(small, spark, tmp_path):
    from meshweave.streaming import regrid_stream

    spark.createDataFrame([(i, float(v), "2024-01-01 00:01:00") for i, v in enumerate([0, 5, 0, 0], 1)], "cell_id long, value double, t string").selectExpr("cell_id", "value", "timestamp(t) as ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cell_id long, value double, ts timestamp").parquet(str(tmp_path / "in"))
    q = regrid_stream(small, stream).writeStream.outputMode("complete").format("memory").queryName("regridded").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.cell_id, r.value) for r in spark.table("regridded").collect()) == [(1, 1.25), (2, 3.75), (3, 0.0)]
