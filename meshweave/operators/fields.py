"""Fields on grids: values at cell centers, cell means, and what array-like outputs of models need before and after regridding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quadrature
from ..functions.fields import Field as FieldFunction
from ..functions.points import lonlat
from ..sources.grid import Grid, rings_of
from .metrics import mirror_fold
from .regridder import Regridder


@dataclass(frozen=True)
class Field:
    """A field and the grid that it is on; ``data`` has cell_id, value and any keys."""

    grid: Grid
    data: DataFrame

    def regrid(self, regridder: Regridder, grid: Grid, **options) -> Field:
        """The field on ``grid``; ghost cells of a folded grid get the values of their twins."""
        out = regridder.regrid(self.data, **options)
        if grid.kind == "fold":
            by, values = (([x] if isinstance(x, str) else list(x)) for x in (options.get("by", []), options.get("values", "value")))
            for value in values:
                out = mirror_fold(out, *grid.shape, value, by=by)
        return Field(grid, out)


def _center(grid: Grid):
    def mean(axis: str):
        return (F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[axis]) / F.size("ring")).alias(axis)

    return F.struct(*map(mean, "xyz" if grid.manifold.spherical else "xy"))


def sample(grid: Grid, f: FieldFunction) -> Field:
    """``f`` of longitude and latitude (of x and y in the plane) at the cells' centers."""
    cells = grid.cells.select("cell_id", _center(grid).alias("c"))
    if grid.manifold.spherical:
        size = F.sqrt(F.col("c.x") * F.col("c.x") + F.col("c.y") * F.col("c.y") + F.col("c.z") * F.col("c.z"))
        unit = F.struct(*[(F.col(f"c.{a}") / size).alias(a) for a in "xyz"])
        cells = cells.select("cell_id", lonlat(unit).alias("at")).select("cell_id", F.col("at.lon").alias("a"), F.col("at.lat").alias("b"))
    else:
        cells = cells.select("cell_id", F.col("c.x").alias("a"), F.col("c.y").alias("b"))
    return Field(grid, cells.select("cell_id", f(F.col("a"), F.col("b")).cast("double").alias("value")))


def cell_means(grid: Grid, f: Callable[[np.ndarray, np.ndarray], np.ndarray], degree: int = 8) -> Field:
    """Means over spherical cells of ``f(lon, lat)`` (numpy, degrees) by quadrature; 0 for cells without area."""
    if not grid.manifold.spherical:
        raise ValueError("cell_means integrates over spherical cells")

    def of_points(p: np.ndarray) -> np.ndarray:
        return f(np.degrees(np.arctan2(p[:, 1], p[:, 0])), np.degrees(np.arcsin(np.clip(p[:, 2], -1, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                means = quadrature.spherical_means(*rings_of(part.column("ring")), of_points, degree)
                yield pa.RecordBatch.from_arrays([part.column("cell_id"), pa.array(means, pa.float64())], ["cell_id", "value"])

    return Field(grid, grid.cells.select("cell_id", "ring").mapInArrow(run, "cell_id bigint, value double"))


def interior(data: DataFrame, shape: tuple[int, int], halo: int) -> DataFrame:
    """Cells of a model's array i, j (1-based, with ``halo`` cells around it) as cell_id of the ``shape`` inside."""
    i, j = F.col("i") - halo, F.col("j") - halo
    inside = data.where(i.between(1, shape[0]) & j.between(1, shape[1]))
    return inside.withColumn("cell_id", (i + (j - 1) * shape[0]).cast("bigint")).drop("i", "j")


#: How the sides of a model's array go on: not at all, from the other side, or folded on themselves at the last row's centers.
SIDES_X, SIDES_Y = ("none", "periodic"), ("none", "periodic", "fold")


def with_halo(field: DataFrame, shape: tuple[int, int], halo: int, *, x: str = "periodic", y: str = "none") -> DataFrame:
    """The other way: cells of a grid (cell_id) as i, j of a model's array, with ``halo`` cells around them filled from those inside.

    ``x`` is none or periodic, ``y`` none, periodic or fold: beyond the folded last row lies the row before it, from right to left.
    Each cell sends its own copies, at most a few, so nothing is exchanged.
    """
    nx, ny = shape
    if x not in SIDES_X or y not in SIDES_Y:
        raise ValueError(f"x is one of {SIDES_X}, y of {SIDES_Y}")
    if not 0 <= halo < min(shape):
        raise ValueError("a halo is narrower than the array")
    i, j = F.pmod(F.col("cell_id") - 1, F.lit(nx)) + 1, F.floor((F.col("cell_id") - 1) / nx) + 1
    place = lambda a, b: F.struct(a.cast("bigint").alias("i"), b.cast("bigint").alias("j"))
    own = F.col("__at")
    rows = [own]
    if y == "periodic":
        rows += [F.when(own["j"] <= halo, place(own["i"], own["j"] + ny)), F.when(own["j"] > ny - halo, place(own["i"], own["j"] - ny))]
    if y == "fold":
        rows += [F.when((own["j"] >= ny - halo) & (own["j"] < ny), place(nx + 1 - own["i"], 2 * ny - own["j"]))]
    out = field.withColumn("__at", place(i, j)).withColumn("__at", F.explode(F.filter(F.array(*rows), lambda p: p.isNotNull())))
    columns = [own]
    if x == "periodic":
        columns += [F.when(own["i"] <= halo, place(own["i"] + nx, own["j"])), F.when(own["i"] > nx - halo, place(own["i"] - nx, own["j"]))]
    out = out.withColumn("__at", F.explode(F.filter(F.array(*columns), lambda p: p.isNotNull())))
    return out.select((own["i"] + halo).alias("i"), (own["j"] + halo).alias("j"), *[c for c in field.columns if c != "cell_id"])
