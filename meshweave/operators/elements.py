"""Reference coordinates of points within bilinear elements, by Newton's iteration on whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.grid import Grid, rings_of

#: Most steps, the longest step in reference coordinates, and the remaining distance, of an element's size, that counts as none.
STEPS, LONGEST, NONE_LEFT = 50, 1.0, 1e-13
#: Reference coordinates of the corners, in the order of a cell's ring.
CORNERS = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)], float)


def bilinear_point(corners: np.ndarray, xi: np.ndarray, eta: np.ndarray) -> np.ndarray:
    """Points (n, 2 or 3) of reference coordinates in elements (n, 4, 2 or 3); on a sphere still to be normalized."""
    shape = (1 + xi[:, None] * CORNERS[:, 0]) * (1 + eta[:, None] * CORNERS[:, 1]) / 4
    return np.einsum("nc,ncd->nd", shape, corners)


def bilinear_coordinates(corners: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """xi and eta of points in [-1, 1]^2 (beyond, outside of their elements); NaN where the iteration does not converge.

    On a sphere a point is found in the direction of its own: what must vanish is the part of the bilinear point that is
    orthogonal to it.
    """
    n = len(points)
    if points.shape[1] == 3:
        axis = np.where(np.abs(points[:, :1]) < 0.7, [[1.0, 0, 0]], [[0, 1.0, 0]])
        east = np.cross(points, axis)
        east /= np.maximum(np.linalg.norm(east, axis=1, keepdims=True), 1e-300)
        frame = np.stack([east, np.cross(points, east)], axis=1)
        flat, aim = np.einsum("nkd,ncd->nck", frame, corners), np.zeros((n, 2))
    else:
        flat, aim = corners, points
    size = np.abs(flat - flat[:, :1]).max(axis=(1, 2))
    xi, eta = np.zeros(n), np.zeros(n)
    left = np.arange(n)
    for _ in range(STEPS):
        own, x, y = flat[left], xi[left], eta[left]
        off = bilinear_point(own, x, y) - aim[left]
        far = np.abs(off).max(axis=1) > NONE_LEFT * size[left]
        left, own, x, y, off = left[far], own[far], x[far], y[far], off[far]
        if not len(left):
            break
        by_xi = np.einsum("nc,ncd->nd", CORNERS[:, 0] * (1 + y[:, None] * CORNERS[:, 1]) / 4, own)
        by_eta = np.einsum("nc,ncd->nd", (1 + x[:, None] * CORNERS[:, 0]) * CORNERS[:, 1] / 4, own)
        det = by_xi[:, 0] * by_eta[:, 1] - by_xi[:, 1] * by_eta[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.stack([(by_eta[:, 1] * off[:, 0] - by_eta[:, 0] * off[:, 1]) / det, (by_xi[:, 0] * off[:, 1] - by_xi[:, 1] * off[:, 0]) / det])
        step *= np.minimum(1, LONGEST / np.maximum(np.abs(step).max(axis=0), 1e-300))
        xi[left], eta[left] = x - step[0], y - step[1]
    # rounding may stop just short of NONE_LEFT
    bad = ~(np.abs(bilinear_point(flat, xi, eta) - aim).max(axis=1) <= 1e3 * NONE_LEFT * size)
    if points.shape[1] == 3:
        bad |= np.einsum("nd,nd->n", bilinear_point(corners, xi, eta), points) <= 0  # the antipode solves it too
    return np.where(bad, np.nan, xi), np.where(bad, np.nan, eta)


def located(points: DataFrame, elements: Grid) -> DataFrame:
    """point_id, elem_id, xi, eta of points (point_id, elem_id, point) in their quadrilateral elements."""
    met = points.select("point_id", "elem_id", "point").join(elements.cells.select(F.col("cell_id").alias("elem_id"), "ring"), "elem_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                corners, size = rings_of(batch.column("ring"))
                if (size != 4).any():
                    raise ValueError("elements have four corners")
                flat = batch.column("point")
                points = np.column_stack([flat.field(k).to_numpy() for k in range(flat.type.num_fields)])
                xi, eta = bilinear_coordinates(corners, points)
                yield pa.RecordBatch.from_arrays([batch.column("point_id"), batch.column("elem_id"), pa.array(xi), pa.array(eta)], ["point_id", "elem_id", "xi", "eta"])

    return met.select(F.col("point_id").cast("bigint").alias("point_id"), F.col("elem_id").cast("bigint").alias("elem_id"), "point", "ring").mapInArrow(run, "point_id bigint, elem_id bigint, xi double, eta double")
