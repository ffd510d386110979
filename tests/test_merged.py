"""Cells of equal geometry as one, against the same grids cell by cell."""

import pytest
from meshweave.operators import build_regridder
from meshweave.operators.candidates import candidate_pairs
from meshweave.operators.merged import AT_ONCE, merged
from meshweave.operators.metrics import regridder_differences, weight_differences
from meshweave.plans import queries
from meshweave.sources import polygon_grid

SF = "/root/testdata/sf0.001"


def box(x, y, w, h):
    return [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


NOTCH = [(0, 0), (4, 0), (4, 3), (2, 1), (0, 3)]
HOLED = {"exterior": box(0, 0, 3, 3), "holes": [box(1, 1, 1, 1)]}


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def grids(spark, height=1.5):
    dst = polygon_grid(spark, [box(k % 3, k % 2, 1, 2.5) for k in range(30)] + [NOTCH] * 3)
    src = polygon_grid(spark, [box(k % 4 - 0.5, k % 3, 1.25, height) for k in range(40)] + [HOLED] * 2 + [box(50, 50, 1, 1)])
    return dst, src


def test_merged_cells_give_the_same_weights(spark):
    dst, src = grids(spark)
    plain = build_regridder(dst, src)
    want = rows(plain.weights)
    m = merged(dst)
    r = build_regridder(m, merged(src))
    assert rows(r.weights) == rows(build_regridder(m, src).weights) == want
    assert r.classes.weights.count() < len(want) / 10
    assert r.shape == plain.shape and rows(r.dst_areas) == rows(plain.dst_areas) and rows(r.src_areas) == rows(plain.src_areas)
    assert rows(r.rounded(3)) == rows(plain.rounded(3))
    assert rows(r.normalize().weights) == rows(plain.normalize().weights)
    assert rows(r.transpose().rounded(9)) == sorted(((b, a, v) for a, b, v in want), key=repr)


def test_large_classes_null_ids_and_ids_of_several_rings(spark):
    """No row has more than a part of a class; an id with two rings is one cell, other than those with one of them."""
    one, other = box(0, 0, 1, 1), box(0.5, 0, 1, 1)
    table = spark.createDataFrame([(k, one) for k in range(2500)] + [(k, other) for k in (7, 8, None)], "cell_id bigint, ring array<struct<x: double, y: double>>")
    dst, src = polygon_grid(spark, table), polygon_grid(spark, [box(-1, -1, 2, 3)])
    m = merged(dst)
    assert m.grid.n_cells == 4 and m.members.select("of").distinct().count() == 3
    sizes = [len(r.ids) for r in m.members.collect()]
    assert sum(sizes) == 2501 and max(sizes) < 2 * AT_ONCE and len(sizes) > 3
    assert rows(build_regridder(m, src).weights) == rows(build_regridder(dst, src).weights)


@pytest.mark.parametrize("share", [True, False])
def test_differences_of_classes_are_those_of_cells(spark, share):
    dst, src = grids(spark)
    other = grids(spark, 1.25)[1]
    other = polygon_grid(spark, other.cells.where("cell_id NOT IN (1, 41, 43)"))  # two classes have fewer cells, one is gone
    plain = [build_regridder(dst, s) for s in (src, other)]
    m = merged(dst)
    found = [build_regridder(m if share else merged(dst), merged(s)) for s in (src, other)]
    columns = ["dst", "src", "one", "other", "off"]
    want = rows(weight_differences(*[r.weights for r in plain], relative=0.125).select(columns))
    assert want and rows(regridder_differences(*found, relative=0.125).select(columns)) == want
    if share:
        assert rows(regridder_differences(found[0], plain[1], relative=0.125).select(columns)) == want


def test_large_candidate_joins_send_nothing_through_the_driver(spark):
    table = spark.range(9000).selectExpr("id + 1 AS cell_id", "array(struct(id * 1d AS x, 0d AS y), struct(id + 1d AS x, 0d AS y), struct(id + 1d AS x, 1d AS y)) AS ring")
    pairs = candidate_pairs(polygon_grid(spark, table), polygon_grid(spark, table.where("cell_id % 10 = 0")))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 900 * 3 - 1


def test_overlap_areas_are_spread_after_they_are_clipped(spark):
    """What is large, the rows of the result, comes last: no exchange, no sum and no Python after it."""
    plan = queries.part_overlap_areas(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < min(plan.index(step) for step in ("Exchange", "Aggregate", "MapInArrow", "Join"))


def test_overlapping_parts_are_spread_after_they_are_found(spark):
    plan = queries.overlapping_parts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < min(plan.index(step) for step in ("Exchange", "Join"))


def test_members_are_not_sent_through_the_driver(spark):
    plan = build_regridder(*map(merged, grids(spark))).weights._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan[: plan.index("MapInArrow")]
