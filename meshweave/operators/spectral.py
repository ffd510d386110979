"""Between cells and spectral elements on the cubed sphere.

An element carries Nq x Nq Gauss-Lobatto nodes.  The overlap of an element and a
cell is cut into triangles, on which products of Lagrange basis functions are
integrated; that gives the weights from nodes to cells.  The way to nodes is a local
L2 projection with those integrals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.quadrature import gauss_lobatto, lagrange, reference_rule
from ..manifold import Manifold, sphere
from ..sources.grid import Grid, rings_of
from ..sources.grids import CUBE, cubed_sphere
from .candidates import candidate_pairs
from .regridder import Regridder


@dataclass(frozen=True)
class SpectralSpace:
    """Elements of an equiangular cubed sphere: ne x ne on each face, numbered face by face, i first."""

    spark: SparkSession
    ne: int
    nq: int
    radius: float = 1.0

    @property
    def manifold(self) -> Manifold:
        return sphere(self.radius)

    @property
    def n_elements(self) -> int:
        return 6 * self.ne * self.ne

    @property
    def n_nodes(self) -> int:
        return self.n_elements * self.nq**2

    def elements(self) -> Grid:
        return cubed_sphere(self.spark, self.ne, radius=self.radius)

    def nodes(self) -> DataFrame:
        """node_id, elem_id, p, q, x, y, z, wj; the quadrature weights wj add up to the sphere's area."""
        ne, nq, radius = self.ne, self.nq, self.radius

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, w = gauss_lobatto(nq)
            eta, xi = (g.ravel() for g in np.meshgrid(x, x, indexing="ij"))
            number, weight = np.arange(nq * nq), (w[:, None] * w[None, :]).ravel()
            for batch in sliced_batches(batches, AT_ONCE):
                elem = batch.column("elem_id").to_numpy()[:, None]
                points = element_points(elem, ne, xi, eta).reshape(-1, 3)
                wj = weight * element_jacobian(elem, ne, xi, eta) * radius**2
                p, q = (np.tile(k, len(elem)) for k in (number % nq + 1, number // nq + 1))
                columns = [((elem - 1) * nq * nq + number + 1).ravel(), np.repeat(elem, nq * nq), p, q, *points.T, wj.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["node_id", "elem_id", "p", "q", "x", "y", "z", "wj"])

        elements = self.spark.range(1, self.n_elements + 1).withColumnRenamed("id", "elem_id")
        return elements.mapInArrow(run, "node_id bigint, elem_id bigint, p bigint, q bigint, x double, y double, z double, wj double")

    def shared_nodes(self) -> DataFrame:
        """node_id, global_node: nodes of neighbouring elements at one place have one number."""
        place = F.struct(*[F.round(F.col(a), 9).alias(a) for a in "xyz"])
        nodes = self.nodes().withColumn("place", F.struct(*[(place[a] + 0.0).alias(a) for a in "xyz"]))
        first = nodes.groupBy("place").agg(F.min("node_id").alias("global_node"))
        return nodes.join(first, "place").select("node_id", "global_node", F.col("wj").alias("weight"))


#: Elements or overlaps that a task works on together.
AT_ONCE = 2048
#: Face, then center and two axes.
FACES = np.array(CUBE, float)


def sliced_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _face(elem: int | np.ndarray, ne: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    face, rest = np.divmod(np.asarray(elem) - 1, ne * ne)
    return FACES[face], rest % ne, rest // ne


def element_points(elem: int | np.ndarray, ne: int, xi: np.ndarray, eta: np.ndarray) -> np.ndarray:
    """Unit vectors at reference coordinates in [-1, 1]^2; elements and coordinates broadcast against one another."""
    axes, i, j = _face(elem, ne)
    u, v = (np.tan(np.pi / 4 * ((k + (s + 1) / 2) * 2 / ne - 1)) for k, s in ((i, xi), (j, eta)))
    p = axes[..., 0, :] + u[..., None] * axes[..., 1, :] + v[..., None] * axes[..., 2, :]
    return p / np.linalg.norm(p, axis=-1, keepdims=True)


def element_coordinates(elem: int | np.ndarray, ne: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``element_points``, in closed form."""
    axes, i, j = _face(elem, ne)
    depth, a, b = ((points * axes[..., k, :]).sum(axis=-1) for k in range(3))
    return tuple(((np.arctan2(along, depth) / (np.pi / 4) + 1) * ne / 2 - k) * 2 - 1 for along, k in ((a, i), (b, j)))


def element_jacobian(elem: int | np.ndarray, ne: int, xi: np.ndarray, eta: np.ndarray) -> np.ndarray:
    """Area of the unit sphere per area of reference coordinates."""
    _, i, j = _face(elem, ne)
    alpha, beta = (np.pi / 4 * ((k + (s + 1) / 2) * 2 / ne - 1) for k, s in ((i, xi), (j, eta)))
    u, v = np.tan(alpha), np.tan(beta)
    return (1 + u * u) * (1 + v * v) / (1 + u * u + v * v) ** 1.5 * (np.pi / (4 * ne)) ** 2


def basis_integrals(elem: np.ndarray, ne: int, nq: int, rings: np.ndarray, size: np.ndarray, degree: int) -> np.ndarray:
    """(polygon, node) integrals of basis functions over polygons within elements (unit sphere); q runs slowest.

    Each polygon is a fan of triangles around its middle; all fans of a call are integrated together.
    """
    bary, weights = reference_rule(degree)
    nodes, _ = gauss_lobatto(nq)
    real = np.arange(rings.shape[1])[None, :] < size[:, None]
    middle = (rings * real[:, :, None]).sum(axis=1)
    middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-300)
    of, k = np.nonzero(real)
    triangles = np.stack([middle[of], rings[of, k], rings[of, (k + 1) % size[of]]], axis=1)
    area = np.abs(kernels.spherical_areas(triangles, np.full(len(of), 3)))
    p = bary @ triangles
    p /= np.maximum(np.linalg.norm(p, axis=2, keepdims=True), 1e-300)
    xi, eta = (lagrange(nodes, s.ravel()).reshape(*s.shape, nq) for s in element_coordinates(elem[of, None], ne, p))
    values = np.einsum("tgq,tgp->tqp", eta * (2 * area[:, None] * weights)[:, :, None], xi)
    out = np.zeros((len(elem), nq * nq))
    np.add.at(out, of, values.reshape(len(of), nq * nq))
    return out


def _integrals(space: SpectralSpace, cells: Grid, degree: int) -> DataFrame:
    """elem, cell, b (array over the element's nodes): basis integrals of each overlap."""
    pairs = candidate_pairs(cells, space.elements())
    ne, nq, scale = space.ne, space.nq, space.radius**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_batches(batches, AT_ONCE):
            s, n = rings_of(batch.column("src_ring"))
            d, m = rings_of(batch.column("dst_ring"))
            s, d = kernels.counterclockwise(s, n, True), kernels.counterclockwise(d, m, True)
            ring, size = kernels.clip(s, n, d, m, True)
            elem, cell = (batch.column(c).to_numpy() for c in ("src_id", "dst_id"))
            some = np.flatnonzero(size > 2)
            b = basis_integrals(elem[some], ne, nq, ring[some], size[some], degree) * scale
            some, b = some[b.any(axis=1)], b[b.any(axis=1)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * nq * nq, pa.int32()), pa.array(b.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(elem[some]), pa.array(cell[some]), lists], ["elem", "cell", "b"])

    return pairs.mapInArrow(run, "elem bigint, cell bigint, b array<double>")


def _node(nq: int):
    return ((F.col("elem") - 1) * nq * nq + F.col("k") + 1).cast("bigint")


def nodes_to_cells(space: SpectralSpace, cells: Grid, *, degree: int | None = None) -> Regridder:
    """The regridder from a spectral space's nodes to a grid's cells."""
    found = _integrals(space, cells, degree or 2 * (space.nq - 1))
    weights = found.select(F.col("cell").alias("dst"), "elem", F.posexplode("b").alias("k", "area")).where("area <> 0")
    weights = weights.select("dst", _node(space.nq).alias("src"), "area").groupBy("dst", "src").agg(F.sum("area").alias("area"))
    nodes = space.nodes().select(F.col("node_id").alias("cell_id"), F.col("wj").alias("area"))
    return Regridder(weights, cells.areas(), nodes, cells.n_cells, space.n_nodes, space.manifold, "spectral")


def local_mass(elem: int, ne: int, nq: int) -> np.ndarray:
    """Mass matrix of an element's basis by a Gauss-Lobatto rule that is exact for the products."""
    nodes, _ = gauss_lobatto(nq)
    x, w = gauss_lobatto(-(-(3 * nq - 2) // 2) + 1)
    eta, xi = (g.ravel() for g in np.meshgrid(x, x, indexing="ij"))
    basis = (lagrange(nodes, eta)[:, :, None] * lagrange(nodes, xi)[:, None, :]).reshape(len(xi), -1)
    weight = (w[:, None] * w[None, :]).ravel() * element_jacobian(elem, ne, xi, eta)
    return np.einsum("gi,g,gj->ij", basis, weight, basis)


def element_masses(space: SpectralSpace) -> DataFrame:
    """elem_id, node_id, other_id, mass: the mass matrices of all elements, a row for each pair of an element's nodes."""
    ne, nq, scale = space.ne, space.nq, space.radius**2
    names = ["elem_id", "node_id", "other_id", "mass"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = (g.ravel() + 1 for g in np.meshgrid(np.arange(nq * nq), np.arange(nq * nq), indexing="ij"))
        for batch in batches:
            for elem in batch.column("elem_id").to_pylist():
                first = (elem - 1) * nq * nq
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(nq**4, elem), first + own, first + other, local_mass(elem, ne, nq).ravel() * scale)], names)

    elements = space.spark.range(1, space.n_elements + 1).withColumnRenamed("id", "elem_id")
    return elements.mapInArrow(run, "elem_id bigint, node_id bigint, other_id bigint, mass double")


def cells_to_nodes(space: SpectralSpace, cells: Grid, *, degree: int | None = None) -> Regridder:
    """The regridder from cells to nodes: in each element, the L2 projection onto the nodes that cells cover.

    Its results are node values as they are (nothing is divided); average them over coincident nodes afterwards.
    """
    ne, nq, scale = space.ne, space.nq, space.radius**2

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        elem, b = int(rows["elem"].iloc[0]), np.stack(rows["b"].to_list())
        full = b.sum(axis=0)
        own = np.flatnonzero(full != 0)
        mass = local_mass(elem, ne, nq)[np.ix_(own, own)] * scale
        sums = mass.sum(axis=1)
        mass *= np.where(sums != 0, full[own] / np.where(sums != 0, sums, 1), 1)[:, None]
        weights = np.linalg.solve(mass, b[:, own].T)
        k, cell = np.meshgrid(own, rows["cell"].to_numpy(), indexing="ij")
        return pd.DataFrame({"elem": elem, "k": k.ravel(), "src": cell.ravel(), "area": weights.ravel()})

    found = _integrals(space, cells, degree or 2 * (space.nq - 1))
    solved = found.groupBy("elem").applyInPandas(solve, "elem bigint, k bigint, src bigint, area double").where("area <> 0")
    nodes = space.nodes().select(F.col("node_id").alias("cell_id"), F.lit(1.0).alias("area"))
    return Regridder(solved.select(_node(nq).alias("dst"), "src", "area"), nodes, cells.areas(), space.n_nodes, cells.n_cells, space.manifold, "spectral", divide=False)


def nodes_to_nodes(*_, **__):
    raise NotImplementedError("there is no regridder between two spectral spaces: go through cells, nodes_to_cells and then cells_to_nodes")
