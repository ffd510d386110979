"""Conservative regridders: a table of overlap areas, and its application to fields.

The weights are (dst, src, area), the areas of both grids come from their
geometry.  Applying is an equi-join with the field and a sum for each destination cell, divided by its area.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.points import divided
from ..functions.shared import written
from ..manifold import Manifold, common_manifold
from ..sources.grid import Grid, as_grid, rings_of
from .candidates import all_pairs, candidate_pairs, interval_overlaps
from .merged import Merged, rounded, spread
from .outlines import outline_weights

#: Kinds of grids whose cells are convex; others may have cells of any shape.
CONVEX = ("regular", "rotated", "rings", "healpix", "cubed")
#: A callable (src ring, dst ring) -> area, on lists of coordinate tuples.
Operator = Callable[[list[tuple], list[tuple]], float]


@dataclass(frozen=True)
class Classes:
    """Weights dst, src, area whose dst and src are classes where there are members of them, else cells."""

    weights: DataFrame
    dst: DataFrame | None
    src: DataFrame | None

    def spread(self, digits: int | None = None, above: float = 0.0) -> DataFrame:
        found = self.weights.where(F.col("area") > above).withColumn("area", rounded(F.col("area"), digits))
        return spread(found, {"dst": self.dst, "src": self.src})


@dataclass(frozen=True)
class Regridder:
    """``weights``: dst, src, area; ``dst_areas`` and ``src_areas``: cell_id, area.

    ``divide`` says whether applying divides by destination areas at all (spectral destinations do not).
    ``classes``: weights between classes of equal cells, of which ``weights`` are spread (see ``merged``), and the members of both sides.
    """

    weights: DataFrame
    dst_areas: DataFrame
    src_areas: DataFrame
    n_dst: int
    n_src: int
    manifold: Manifold
    kind: str = "cells"
    divide: bool = True
    classes: Classes | None = None

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_dst, self.n_src

    def size(self, dim: int | None = None) -> int | tuple[int, int]:
        return self.shape if dim is None else self.shape[dim - 1]

    def __repr__(self) -> str:
        return f"{self.n_dst}×{self.n_src} Regridder ({self.manifold.kind}, {self.kind})"

    def persist(self) -> Regridder:
        for table in (self.weights, self.dst_areas, self.src_areas):
            table.persist()
        return self

    def unpersist(self) -> Regridder:
        for table in (self.weights, self.dst_areas, self.src_areas):
            table.unpersist()
        return self

    def transpose(self) -> Regridder:
        """The way back: sides and areas swapped, nothing computed."""
        if self.kind == "spectral":
            raise NotImplementedError("the transpose of a spectral regridder is not conservative: build the other direction")
        swapped = self.weights.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "area")
        return replace(self, weights=swapped, dst_areas=self.src_areas, src_areas=self.dst_areas, n_dst=self.n_src, n_src=self.n_dst, classes=None)

    def normalize(self) -> Regridder:
        """Weights and areas divided by the largest weight; applying gives the same fields."""
        most = F.broadcast(self.weights.agg(F.max("area").alias("most")))  # one row

        def scaled(table: DataFrame) -> DataFrame:
            return table.crossJoin(most).withColumn("area", F.col("area") / F.coalesce("most", F.lit(1.0))).drop("most")

        return replace(self, weights=scaled(self.weights), dst_areas=scaled(self.dst_areas), src_areas=scaled(self.src_areas), classes=None)

    def marginals(self) -> tuple[DataFrame, DataFrame]:
        """(cell_id, area, total, frac) of destination and source cells: the overlap of each and its share of the cell."""

        def side(name: str, areas: DataFrame) -> DataFrame:
            total = self.weights.groupBy(F.col(name).alias("cell_id")).agg(F.sum("area").alias("total"))
            joined = areas.join(total, "cell_id", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
            return joined.withColumn("frac", divided(F.col("total"), F.col("area")))

        return side("dst", self.dst_areas), side("src", self.src_areas)

    def rounded(self, digits: int, above: float = 0.0) -> DataFrame:
        """The weights ``above`` some area, then rounded; where classes of cells have them, each is rounded once."""
        return self.classes.spread(digits, above) if self.classes else self.weights.where(F.col("area") > above).withColumn("area", F.round("area", digits))

    def covered(self) -> DataFrame:
        """cell_id of destination cells that some source cell overlaps."""
        return self.dst_areas.join(self.weights.select(F.col("dst").alias("cell_id")), "cell_id", "left_semi").select("cell_id")

    def regrid(self, field: DataFrame, *, key: str = "cell_id", values: list[str] | str = "value", by: list[str] | str = (), normalize: bool = True) -> DataFrame:
        """cell_id, the columns in ``by``, and ``values`` on the destination grid.

        Every destination cell gets a row, for every combination of ``by`` in the
        field: 0.0 where nothing overlaps it, NaN where its area is 0.  NaN values spread to all cells that
        they overlap; null values count as nothing.  ``normalize=False`` leaves the weighted sums undivided.
        """
        values, by = [values] if isinstance(values, str) else list(values), [by] if isinstance(by, str) else list(by)
        missing = [c for c in [key, *values, *by] if c not in field.columns]
        if missing:
            raise ValueError(f"the field has no columns {missing}")
        source = field.select(F.col(key).alias("src"), *by, *[F.col(v).cast("double").alias(v) for v in values])
        sums = self.weights.join(source, "src").groupBy("dst", *by).agg(*[F.sum(F.col("area") * F.col(v)).alias(v) for v in values])
        areas = self.dst_areas.withColumnRenamed("area", "__area")
        if by:
            groups = field.select(*by).distinct()
            every = areas.crossJoin(groups)
            match = F.col("cell_id") == F.col("dst")
            sums = sums.select("dst", *[F.col(c).alias(f"__{c}") for c in by], *values)
            for c in by:
                match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
            joined = every.join(sums, match, "left")
        else:
            joined = areas.join(sums, F.col("cell_id") == F.col("dst"), "left")
        found = {v: F.coalesce(v, F.lit(0.0)) for v in values}
        if normalize and self.divide:
            found = {v: divided(c, F.col("__area")) for v, c in found.items()}
        return joined.select("cell_id", *by, *[c.alias(v) for v, c in found.items()])

    def regrid_array(self, array: np.ndarray, *, dims: int = 1, normalize: bool = True) -> np.ndarray:
        """The same for a small numpy array with the cells along axis ``dims`` (1-based); other axes are kept."""
        if not isinstance(array, np.ndarray):
            raise TypeError("regrid_array takes a numpy array")
        if not 1 <= dims <= array.ndim:
            raise ValueError(f"dims is {dims}, the array has {array.ndim} axes")
        if array.shape[dims - 1] != self.n_src:
            raise ValueError(f"axis {dims} has {array.shape[dims - 1]} entries, the source grid {self.n_src} cells")
        moved = np.moveaxis(np.asarray(array, float), dims - 1, 0)
        flat = moved.reshape(self.n_src, -1)
        spark = self.weights.sparkSession
        table = spark.createDataFrame([(i + 1, row.tolist()) for i, row in enumerate(flat)], "cell_id bigint, v array<double>")
        found = self.regrid(table.select("cell_id", F.posexplode("v").alias("k", "value")), by="k", normalize=normalize).collect()
        out = np.zeros((self.n_dst, flat.shape[1]))
        for r in found:
            out[r["cell_id"] - 1, r["k"]] = r["value"]
        return np.moveaxis(out.reshape(self.n_dst, *moved.shape[1:]), 0, dims - 1)

    @staticmethod
    def from_weights(weights: DataFrame, dst_areas: DataFrame, src_areas: DataFrame, manifold: Manifold) -> Regridder:
        """A regridder of existing tables; equal (dst, src) pairs are summed."""
        return Regridder(_summed(weights), dst_areas, src_areas, dst_areas.count(), src_areas.count(), manifold)


def _summed(weights: DataFrame) -> DataFrame:
    return weights.groupBy("dst", "src").agg(F.sum("area").alias("area"))


def _overlaps(pairs: DataFrame, manifold: Manifold, operator: Operator | None) -> DataFrame:
    """dst, src, area of candidate pairs, with the areas that are positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if operator is not None:
                rings = [[[tuple(p.values()) for p in ring] for ring in batch.column(c).to_pylist()] for c in ("src_ring", "dst_ring")]
                ids = zip(batch.column("src_id").to_pylist(), batch.column("dst_id").to_pylist(), strict=True)
                area = np.array([_applied(operator, s, d, *own) for s, d, own in zip(*rings, ids, strict=True)])
            else:
                s, n = rings_of(batch.column("src_ring"))
                d, m = rings_of(batch.column("dst_ring"))
                area = np.concatenate([kernels.intersection_areas(s[i : i + 4096], n[i : i + 4096], d[i : i + 4096], m[i : i + 4096], manifold.spherical) for i in range(0, len(n), 4096)])
                area *= manifold.radius**2 if manifold.spherical else 1.0
            keep = area > 0  # not NaN either
            yield pa.RecordBatch.from_arrays([batch.column("dst_id").filter(pa.array(keep)), batch.column("src_id").filter(pa.array(keep)), pa.array(area[keep])], ["dst", "src", "area"])

    return pairs.mapInArrow(run, "dst bigint, src bigint, area double")


def _applied(operator: Operator, src: list[tuple], dst: list[tuple], src_id: int, dst_id: int) -> float:
    try:
        return float(operator(src, dst))
    except Exception as e:
        raise ValueError(f"the operator failed for source cell {src_id} and destination cell {dst_id}") from e


def _convex(grid: Grid) -> Grid:
    """The grid with cells that are not convex, or have holes, in convex parts (of one id), each cell cut once."""

    spherical = grid.manifold.spherical

    def made(ids: pa.Array, sizes: np.ndarray, coordinates: list[np.ndarray]) -> pa.RecordBatch:
        points = pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in coordinates], list("xyz")[: len(coordinates)])
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), points)], ["cell_id", "ring"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, whole = batch.schema.names, batch.column("ring")
            holes = batch.column("holes").to_pylist() if "holes" in names else [None] * batch.num_rows
            sizes = whole.value_lengths().to_numpy()
            plain = np.array([not h for h in holes], bool)
            for size in np.unique(sizes[plain]).tolist():  # rings of one length are judged together
                at = np.flatnonzero(plain & (sizes == size))
                rings, n = rings_of(whole.take(pa.array(at)))
                plain[at] = kernels.convex(kernels.counterclockwise(rings, n, spherical), n)
            kept = whole.filter(pa.array(plain)).flatten()
            yield made(batch.column("cell_id").filter(pa.array(plain)), sizes[plain], [kept.field(k).to_numpy() for k in range(kept.type.num_fields)])
            for i in np.flatnonzero(~plain):
                ring = np.array([list(p.values()) for p in whole[i].as_py()], float)
                parts = kernels.convex_parts(ring, [np.array([list(p.values()) for p in h], float) for h in holes[i] or []])
                if parts:
                    yield made(pa.array([batch.column("cell_id")[i].as_py()] * len(parts), pa.int64()), np.array([len(p) for p in parts]), list(np.concatenate(parts).T))

    columns = [F.col("cell_id").cast("bigint").alias("cell_id"), "ring", *[c for c in ("holes",) if c in grid.cells.columns]]
    point = "struct<x: double, y: double, z: double>" if spherical else "struct<x: double, y: double>"
    cells = grid.cells.where(~grid.is_ghost()).select(*columns).mapInArrow(run, f"cell_id bigint, ring array<{point}>")
    return replace(grid, cells=cells, kind="parts")


def _lattice_overlaps(dst: Grid, src: Grid) -> DataFrame:
    """dst, src, area between two outer products of edges: lengths of overlap along each axis, and their products."""

    def along(one: str, other: str, axis: str) -> DataFrame:
        def intervals(grid: Grid) -> DataFrame:
            ends = [F.get("ring", F.lit(k))[axis] for k in (0, 2)]
            return grid.cells.where(F.col(other) == 1).select(F.col(one).alias("k"), F.least(*ends).alias("low"), F.greatest(*ends).alias("high"))

        found = interval_overlaps(intervals(dst), intervals(src))
        return found.select(F.col("dst").alias(one), F.col("src").alias(f"src_{one}"), F.col("length").alias(f"length_{one}"))

    cells = dst.cells.select(F.col("cell_id").alias("dst"), "i", "j")
    met = cells.join(along("i", "j", "x"), "i").join(along("j", "i", "y"), "j")
    source = src.cells.select(F.col("cell_id").alias("src"), F.col("i").alias("src_i"), F.col("j").alias("src_j"))
    area = F.col("length_i") * F.col("length_j")
    return met.join(source, ["src_i", "src_j"]).select("dst", "src", area.alias("area")).where("area > 0 AND NOT isnan(area)")


def _has_axes(grid: Grid) -> bool:
    return grid.axes is not None and "is_ghost" not in grid.cells.columns and all(a.rising for a in grid.axes)


def build_regridder(dst, src, *, manifold: Manifold | None = None, normalize: bool = False, operator: Operator | None = None, width: float | None = None, nested_loop: bool = False) -> Regridder:
    """The regridder from ``src`` to ``dst`` (grids, merged grids, or anything ``as_grid`` takes).

    ``operator(src_ring, dst_ring)`` replaces the overlap area; pairs for which it is not positive are left out.
    ``width`` (of the bins) and ``nested_loop`` change how candidates are found, never the result.
    """
    if isinstance(dst, Merged) or isinstance(src, Merged):
        return _of_classes(dst, src, normalize, manifold=manifold, operator=operator, width=width, nested_loop=nested_loop)
    dst, src = as_grid(dst), as_grid(src)
    manifold = manifold or common_manifold(dst.manifold, src.manifold)
    for grid in (dst, src):
        if grid.manifold.spherical != manifold.spherical:
            raise ValueError(f"a {grid.manifold.kind} grid has no cells on a {manifold.kind} manifold: convert its points first")
    dst, src = replace(dst, manifold=manifold), replace(src, manifold=manifold)
    if manifold.spherical:  # areas, caps and overlaps all need the corners, which are long expressions
        dst, src = (replace(g, cells=written(g.cells)) for g in (dst, src))
    if operator is None and not manifold.spherical and dst.kind == src.kind == "regular":
        weights = _lattice_overlaps(dst, src)
    elif operator is None and not manifold.spherical and not nested_loop and any(_has_axes(g) for g in (dst, src)):
        if _has_axes(dst):
            weights = outline_weights(dst, src)
        else:
            weights = outline_weights(src, dst).select(F.col("src").alias("dst"), F.col("dst").alias("src"), "area")
    elif operator is None and any(g.kind not in CONVEX for g in (dst, src)):
        parts = [g if g.kind in CONVEX else _convex(g) for g in (dst, src)]
        weights = _summed(_overlaps(all_pairs(*parts) if nested_loop else candidate_pairs(*parts, width=width), manifold, None))
    else:
        weights = _overlaps(all_pairs(dst, src) if nested_loop else candidate_pairs(dst, src, width=width), manifold, operator)
    found = Regridder(weights, dst.areas(), src.areas(), dst.n_cells, src.n_cells, manifold)
    return found.normalize() if normalize else found


def _of_classes(dst, src, normalize: bool, **options) -> Regridder:
    """The regridder of grids of which one at least is merged: weights of classes, spread over their members."""
    grids = [g.grid if isinstance(g, Merged) else g for g in (dst, src)]
    found = build_regridder(*grids, **options)
    # an operator may be asked for the parts of a class one by one
    classes = Classes(_summed(found.weights), *[g.members if isinstance(g, Merged) else None for g in (dst, src)])
    whole = [as_grid(g.whole if isinstance(g, Merged) else g) for g in (dst, src)]
    dst, src = (replace(g, manifold=found.manifold) for g in whole)
    found = replace(found, weights=classes.spread(), dst_areas=dst.areas(), src_areas=src.areas(), n_dst=dst.n_cells, n_src=src.n_cells, classes=classes)
    return found.normalize() if normalize else found
