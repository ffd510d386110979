import numpy as np
import pytest
from meshweave.functions import fields
from meshweave.operators import build_regridder
from meshweave.operators.fields import Field, cell_means, interior, sample
from meshweave.sources import fold_grid, latlon_grid, regular_grid
from pyspark.sql import functions as F


def values(field):
    return np.array([r.value for r in sorted(field.data.collect(), key=lambda r: r.cell_id)])


def test_samples_and_means_agree(spark):
    grid = latlon_grid(spark, 24, 12, lon=(-180.0, 180.0))
    f = lambda lon, lat: 2 - np.cos(np.arccos(np.cos(np.radians(lon)) * np.cos(np.radians(lat))) / 1.2)
    off = np.abs(values(sample(grid, fields.sinusoid_field())) - values(cell_means(grid, f)))
    assert off[24:-24].max() < 0.02
    assert off.max() < 0.05  # polar cells are triangles: their four vertices' mean lies nearer to the pole than their centroid
    assert np.allclose(values(cell_means(grid, lambda lon, lat: np.full(lon.shape, 3.0))), 3)
    plane = regular_grid(spark, [0, 1, 2], [0, 2])
    assert values(sample(plane, lambda x, y: x + y)).tolist() == [1.5, 2.5]
    with pytest.raises(ValueError):
        cell_means(plane, f)


def test_a_field_on_a_folded_grid(spark):
    src, dst = latlon_grid(spark, 4, 2), fold_grid(latlon_grid(spark, 8, 4))
    field = Field(src, src.cells.select("cell_id", F.lit(2.0).alias("value")))
    assert np.allclose(values(field.regrid(build_regridder(dst, src), dst)), 2)


def test_interior_of_an_array_with_halo(spark):
    rows = [(i, j, float(10 * i + j)) for i in range(1, 6) for j in range(1, 5)]
    got = interior(spark.createDataFrame(rows, "i int, j int, value double"), (3, 2), 1)
    assert sorted((r.cell_id, r.value) for r in got.collect()) == [(1, 22), (2, 32), (3, 42), (4, 23), (5, 33), (6, 43)]
