"""Counts and sums of points in regions, against the points themselves."""

import numpy as np
import pytest
from meshweave.functions import kernels
from meshweave.operators.pixels import cap_poles, points_in_regions, polygon_poles, sums_in_regions
from meshweave.plans import shapes
from pyspark.sql import functions as F

POINT = "struct<x: double, y: double, z: double>"
SF = "/root/testdata/sf0.001"


def directions(n, seed):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def test_sums_of_repeated_points_in_repeated_regions(spark):
    p, c = directions(500, 1).repeat(4, axis=0), directions(20, 2).repeat(3, axis=0)
    reach = np.linspace(0.001, 3.2, 20).repeat(3)
    points = spark.createDataFrame([(i, (*map(float, x),)) for i, x in enumerate(p)], f"point_id bigint, point {POINT}")
    caps = spark.createDataFrame([(i, (*map(float, x),), float(r)) for i, (x, r) in enumerate(zip(c, reach, strict=True))], f"region_id bigint, c {POINT}, r double").select("region_id", cap_poles(F.col("c"), F.col("r")).alias("poles"))
    near = kernels.angles(p[:, None], c[None]) <= reach
    want = {k: (int(near[:, k].sum()), int(np.flatnonzero(near[:, k]).sum())) for k in range(60) if near[:, k].any()}
    for depth in (0, 4):
        assert {r.region_id: (r.n, r.ids) for r in sums_in_regions(points, caps, depth).collect()} == want
    assert len(want) < 60


def test_sums_are_those_of_the_points_met(spark):
    p, rings = directions(800, 3), directions(60, 4).reshape(20, 3, 3)
    rings[np.linalg.det(rings) < 0] = rings[np.linalg.det(rings) < 0][:, ::-1]
    points = spark.createDataFrame([(i, (*map(float, x),)) for i, x in enumerate(p)], f"point_id bigint, point {POINT}")
    table = spark.createDataFrame([(k, [(*map(float, v),) for v in r]) for k, r in enumerate(rings)], f"region_id bigint, ring array<{POINT}>").select("region_id", polygon_poles(F.col("ring")).alias("poles"))
    met = points_in_regions(points, table, 3).groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.sum("point_id").alias("ids"))
    assert sorted(map(tuple, sums_in_regions(points, table, 3).collect())) == sorted(map(tuple, met.collect()))


@pytest.mark.parametrize("name", ["customers_near_suppliers", "customers_in_triangles"])
def test_keys_and_pairs_are_neither_broadcast_nor_moved(spark, name):
    """Nothing goes through the driver, and what points and regions make up is summed in the task that finds it."""
    plan = shapes.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    tested = plan[plan.index("ArrayForall") if "ArrayForall" in plan else plan.index("forall(") :]
    above = plan[: plan.index(tested[:20])]
    assert "partial_sum" in above.rsplit("Exchange", 1)[1]
