"""Areas and extents of cells as column expressions.  A ring is an open array of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..manifold import Manifold
from .points import cross, distance, dot

def following(ring: Column) -> Column:
    """The ring turned by one vertex."""
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def planar_area(ring: Column) -> Column:
    """Unsigned area by the shoelace formula."""
    edges = F.zip_with(ring, following(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda s, x: s + x)) / 2


def triangle_excess(a: Column, b: Column, c: Column) -> Column:
    """Signed solid angle of a spherical triangle (Van Oosterom & Strackee)."""
    return 2 * F.atan2(dot(a, cross(b, c)), 1 + dot(a, b) + dot(b, c) + dot(c, a))


def spherical_area(ring: Column) -> Column:
    """Unsigned solid angle of a polygon, as a fan from its first vertex."""
    first = F.get(ring, F.lit(0))
    fan = F.zip_with(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 2, F.lit(0))), F.slice(ring, F.lit(3), F.greatest(F.size(ring) - 2, F.lit(0))), lambda b, c: triangle_excess(first, b, c))
    return F.abs(F.aggregate(fan, F.lit(0.0), lambda s, x: s + x))


def area(ring: Column, manifold: Manifold) -> Column:
    return spherical_area(ring) * F.lit(manifold.radius**2) if manifold.spherical else planar_area(ring)


def box(ring: Column) -> dict[str, Column]:
    """Bounding box of a planar ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "xmax": F.array_max(xs), "ymin": F.array_min(ys), "ymax": F.array_max(ys)}


def boxes_overlap(a: str, b: str) -> Column:
    """Closed overlap of two bounding boxes, columns prefixed by ``a`` and ``b``."""
    c = F.col
    return (c(f"{a}xmin") <= c(f"{b}xmax")) & (c(f"{b}xmin") <= c(f"{a}xmax")) & (c(f"{a}ymin") <= c(f"{b}ymax")) & (c(f"{b}ymin") <= c(f"{a}ymax"))


def caps_overlap(a: Column, b: Column) -> Column:
    return distance(a["center"], b["center"]) <= a["radius"] + b["radius"]
