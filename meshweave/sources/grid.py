"""A grid is a table of cells, its shape and the manifold it lies on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, polygons
from ..manifold import Manifold


class Axis:
    """The edges along one axis of a lattice: given, or at equal steps (start, step, n) without a vector."""

    def __init__(self, edges=None, *, start: float = 0.0, step: float = 1.0, n: int = 0):
        self.edges = None if edges is None else np.asarray(edges, float)
        self.start, self.step, self.n = start, step, n if edges is None else len(self.edges) - 1

    @property
    def rising(self) -> bool:
        return self.step > 0 if self.edges is None else bool((np.diff(self.edges) > 0).all())

    def at(self, k) -> np.ndarray:
        """Coordinate of edge ``k``, 0-based."""
        return self.start + np.asarray(k) * self.step if self.edges is None else self.edges[k]

    def find(self, v: np.ndarray) -> np.ndarray:
        """The interval that holds ``v``, -1 before the first edge and n from the last edge on."""
        if self.edges is not None:
            return np.searchsorted(self.edges, v, side="right") - 1
        k = np.clip(np.floor((v - self.start) / self.step), -1, self.n).astype(np.int64)
        k = k - (self.at(k) > v)  # as ``at`` rounds
        return np.clip(k + (self.at(k + 1) <= v), -1, self.n)


@dataclass(frozen=True)
class Grid:
    """``cells``: cell_id (1-based), ring (open array of points) and, where known, i, j, face, holes, is_ghost.

    Any table with cell_id and ring makes a grid.  Ghost cells have ids and no area, and never meet other cells.
    ``axes`` are the edges of a lattice whose ids are column-major.
    """

    cells: DataFrame
    shape: tuple[int, ...]
    manifold: Manifold
    kind: str = "cells"
    axes: tuple[Axis, Axis] | None = None

    @property
    def n_cells(self) -> int:
        n = 1
        for k in self.shape:
            n *= k
        return n

    def ncells(self, dim: int | None = None) -> int | tuple[int, ...]:
        return self.shape if dim is None else self.shape[dim - 1]

    def cell(self, *index: int) -> DataFrame:
        """One cell by its id or by (i, j)."""
        if len(index) == 1:
            wanted = index[0]
        else:
            if any(not 1 <= k <= n for k, n in zip(index, self.shape, strict=True)):
                raise IndexError(f"cell {index} outside of {self.shape}")
            wanted = cartesian_to_linear(index, self.shape)
        if not 1 <= wanted <= self.n_cells:
            raise IndexError(f"cell {wanted} outside of 1..{self.n_cells}")
        return self.cells.where(F.col("cell_id") == wanted)

    def is_ghost(self) -> Column:
        return F.coalesce(F.col("is_ghost"), F.lit(False)) if "is_ghost" in self.cells.columns else F.lit(False)

    def areas(self) -> DataFrame:
        """cell_id, area of every cell, from its geometry; 0 for ghosts."""
        own = polygons.area(F.col("ring"), self.manifold)
        if "holes" in self.cells.columns and not self.manifold.spherical:
            own = own - F.aggregate(F.coalesce(F.col("holes"), F.array()), F.lit(0.0), lambda s, h: s + polygons.planar_area(h))
        return self.cells.select("cell_id", F.when(self.is_ghost(), 0.0).otherwise(own).alias("area"))

    def extents(self) -> DataFrame:
        """The cells with their bounding boxes, or caps on a sphere."""
        if self.manifold.spherical:
            return _with_caps(self.cells)
        return self.cells.withColumns(polygons.box(F.col("ring")))

    def with_ids(self, permutation: DataFrame) -> Grid:
        """Another order of the cells: ``permutation`` has cell_id and new_id."""
        cells = self.cells.join(permutation, "cell_id").drop("cell_id").withColumnRenamed("new_id", "cell_id")
        return replace(self, cells=cells, axes=None)

    def with_offset(self, offset: int) -> Grid:
        return replace(self, cells=self.cells.withColumn("cell_id", F.col("cell_id") + offset), axes=None)


CAP = "struct<center: struct<x: double, y: double, z: double>, radius: double>"


def rings_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rings of an Arrow column as a padded array, with their numbers of vertices."""
    points = column.flatten()
    coordinates = np.column_stack([points.field(i).to_numpy(zero_copy_only=False) for i in range(points.type.num_fields)])
    sizes = np.diff(column.offsets.to_numpy())
    return kernels.padded(np.concatenate([[0], np.cumsum(sizes)]), coordinates)


def _with_caps(cells: DataFrame) -> DataFrame:
    """Adds cap; in numpy, since it needs every vertex several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                center, radius = kernels.caps(*rings_of(batch.column("ring")))
                centers = pa.StructArray.from_arrays([pa.array(center[:, k]) for k in range(3)], ["x", "y", "z"])
                cap = pa.StructArray.from_arrays([centers, pa.array(radius)], ["center", "radius"])
                yield pa.RecordBatch.from_arrays([*batch.columns, cap], [*batch.schema.names, "cap"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields)
    return cells.mapInArrow(run, f"{fields}, cap {CAP}")


def linear_to_cartesian(cell_id: Column, n1: int) -> tuple[Column, Column]:
    """Column-major: i runs first."""
    zero = cell_id - 1
    return (F.pmod(zero, F.lit(n1)) + 1).cast("int"), (F.floor(zero / n1) + 1).cast("int")


def cartesian_to_linear(index: tuple, shape: tuple[int, ...]):
    return index[0] + (index[1] - 1) * shape[0]


def union_grids(parts: list[Grid], *, faces: bool = False) -> Grid:
    """Grids one after another: each part's ids follow those before it.  ``faces`` numbers the parts."""
    if len({p.manifold for p in parts}) != 1:
        raise ValueError("the parts of a grid lie on one manifold")
    offset, tables = 0, []
    for number, part in enumerate(parts, 1):
        cells = part.with_offset(offset).cells
        tables.append(cells.withColumn("face", F.lit(number)) if faces else cells)
        offset += part.n_cells
    cells = tables[0]
    for table in tables[1:]:
        cells = cells.unionByName(table, allowMissingColumns=True)
    return Grid(cells, (offset,), parts[0].manifold, "union")


def with_ghosts(grid: Grid, n: int) -> Grid:
    """The grid and ``n`` more cells, ghosts without geometry, after its own: a part as long as its slots in a field."""
    spark, kind = grid.cells.sparkSession, grid.cells.schema["ring"].dataType
    own = grid.cells if "is_ghost" in grid.cells.columns else grid.cells.withColumn("is_ghost", F.lit(False))
    first = grid.n_cells + 1
    ghosts = spark.range(first, first + n).select(F.col("id").alias("cell_id"), F.array().cast(kind).alias("ring"), F.lit(True).alias("is_ghost"))
    return Grid(own.unionByName(ghosts, allowMissingColumns=True), (first + n - 1,), grid.manifold, "padded")


def part_of(cell_id: Column, sizes: list[int]) -> tuple[Column, Column]:
    """The part (1-based) of a union that holds a cell, and the cell's number there: the last part that begins before it."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
    before = F.array(*[F.lit(s).cast("bigint") for s in starts])
    part = F.size(F.filter(before, lambda s: s < cell_id))
    return part, cell_id - F.get(before, part - 1)


def as_grid(obj, spark: SparkSession | None = None, manifold: Manifold | None = None) -> Grid:
    """A grid from a grid, a pair of edge vectors, a matrix of corner points, polygons, or a table cell_id, ring."""
    from .grids import corner_grid, polygon_grid, regular_grid

    if isinstance(obj, Grid):
        return replace(obj, manifold=manifold) if manifold else obj
    spark = spark or SparkSession.getActiveSession()
    if isinstance(obj, DataFrame) and {"cell_id", "ring"} <= set(obj.columns):
        return polygon_grid(spark, obj, manifold=manifold)
    if isinstance(obj, tuple) and len(obj) == 2 and all(np.ndim(x) == 1 for x in obj):
        return regular_grid(spark, *obj, manifold=manifold)
    if isinstance(obj, np.ndarray) and obj.ndim == 3 and obj.dtype.kind in "fiu" and obj.shape[2] in (2, 3):
        return corner_grid(spark, obj, manifold=manifold)
    if isinstance(obj, list) and obj and all(np.ndim(p) == 2 or isinstance(p, dict) for p in obj):
        return polygon_grid(spark, obj, manifold=manifold)
    raise TypeError(f"no grid can be made of {type(obj).__name__}")
