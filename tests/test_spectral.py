from math import pi

import numpy as np
import pytest
from meshweave.operators.metrics import average_coincident, integral
from meshweave.operators.spectral import SpectralSpace, cells_to_nodes, element_coordinates, element_points, local_mass, nodes_to_cells, nodes_to_nodes
from meshweave.sources import latlon_grid
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def space(spark):
    return SpectralSpace(spark, 3, 4)


def column(table, name="value"):
    return np.array([r[name] for r in sorted(table.collect(), key=lambda r: r.cell_id)])


def test_nodes(space):
    nodes = space.nodes().toPandas()
    assert len(nodes) == space.n_nodes == nodes.node_id.nunique() and np.isclose(nodes.wj.sum(), 4 * pi, rtol=1e-5)
    assert space.shared_nodes().select("global_node").distinct().count() == 6 * 9 * 9 + 2
    rng = np.random.default_rng(0)
    for elem in (1, 14, 54):
        xi, eta = rng.uniform(-1, 1, (2, 20))
        assert np.allclose(element_coordinates(elem, 3, element_points(elem, 3, xi, eta)), (xi, eta), atol=1e-10)
    assert np.isclose(sum(local_mass(e, 3, 4).sum() for e in range(1, 55)), 4 * pi, rtol=1e-6)


def test_nodes_to_cells(space, spark):
    cells = latlon_grid(spark, 16, 8)
    r = nodes_to_cells(space, cells).persist()
    ones = space.nodes().select(F.col("node_id").alias("cell_id"), F.lit(2.0).alias("value"))
    assert np.allclose(column(r.regrid(ones)), 2, atol=1e-7)
    smooth = space.nodes().select(F.col("node_id").alias("cell_id"), (1 + F.col("z") + F.col("x") * F.col("y")).alias("value"))
    there = integral(r.regrid(smooth), r.dst_areas).first().integral
    assert np.isclose(there, 4 * pi, rtol=2e-3)
    with pytest.raises(NotImplementedError):
        r.transpose()
    with pytest.raises(NotImplementedError):
        nodes_to_nodes(space, space)


def test_cells_to_nodes(space, spark):
    r = cells_to_nodes(space, latlon_grid(spark, 16, 8)).persist()
    ones = r.src_areas.select("cell_id", F.lit(3.0).alias("value"))
    out = r.regrid(ones)
    assert np.allclose(column(out), 3, atol=1e-6)
    joined = out.withColumnRenamed("cell_id", "node_id").join(space.shared_nodes(), "node_id")
    mean = average_coincident(joined)
    assert np.isclose(mean.agg(F.sum(F.col("value") * F.col("weight"))).first()[0], 3 * 4 * pi, rtol=1e-5)
