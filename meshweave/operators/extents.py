"""Extents of groups of cells: boxes in the plane, caps on a sphere, by sums and maxima that tasks can merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import SLACK
from ..functions.points import distance, midpoint, normalized
from ..functions.polygons import following
from ..sources.grid import Grid

#: Radius of the whole sphere, a little beyond half a turn.
WHOLE = 3.1415926535897936
#: Means of unit vectors shorter than this have no direction: the group goes round the sphere.
NO_DIRECTION = 1e-12


def extents_by(grid: Grid, by: list[str]) -> DataFrame:
    """``by`` with xmin, xmax, ymin, ymax of a group's cells, or with cap (center, radius) around them.

    A cap's center is the normalized mean of all vertices, its radius reaches the farthest vertex or middle of an edge, a little
    enlarged.  Cells that go round the sphere, or balance each other, have the whole sphere.  Two passes of partial
    sums: no group is ever in one task.
    """
    cells = grid.cells.where(~grid.is_ghost())
    if not grid.manifold.spherical:
        boxes = grid.extents().where(~grid.is_ghost())
        return boxes.groupBy(*by).agg(*[f(c).alias(c) for f, c in ((F.min, "xmin"), (F.max, "xmax"), (F.min, "ymin"), (F.max, "ymax"))])
    points = cells.select(*by, F.explode("ring").alias("p"))
    total = points.groupBy(*by).agg(*[F.avg(f"p.{a}").alias(a) for a in "xyz"])
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    whole = length < NO_DIRECTION
    size = F.when(whole, 1.0).otherwise(length)
    center = F.struct(*[F.when(whole, float(a == "z")).otherwise(F.col(a) / size).alias(a) for a in "xyz"])
    centers = total.select(*[F.col(c).alias(f"__{c}") for c in by], center.alias("center"), whole.alias("whole"))
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    edges = F.flatten(F.zip_with("ring", following(F.col("ring")), lambda a, b: F.array(a, midpoint(a, b))))
    far = F.array_max(F.transform(edges, lambda p: distance(F.col("center"), p)))
    reached = cells.join(centers, match).select(*by, "center", "whole", far.alias("far"))
    radius = F.when(F.col("whole"), WHOLE).otherwise(F.least(F.col("far") * SLACK, F.lit(WHOLE)))
    return reached.groupBy(*by, "center", "whole").agg(F.max("far").alias("far")).select(*by, F.struct("center", radius.alias("radius")).alias("cap"))


def merged_cap(a: Column, b: Column) -> Column:
    """The smallest cap that holds two caps."""
    apart = distance(a["center"], b["center"])
    radius = (a["radius"] + b["radius"] + apart) / 2
    turn = F.when(apart == 0, 0.0).otherwise((radius - a["radius"]) / F.when(apart == 0, 1.0).otherwise(apart))
    one, other = F.sin((1 - turn) * apart), F.sin(turn * apart)
    between = normalized(F.struct(*[(one * a["center"][k] + other * b["center"][k]).alias(k) for k in "xyz"]))
    whole = F.struct(F.struct(*[F.lit(float(k == "z")).alias(k) for k in "xyz"]).alias("center"), F.lit(WHOLE).alias("radius"))
    return F.when(apart + b["radius"] <= a["radius"], a).when(apart + a["radius"] <= b["radius"], b).when(radius >= WHOLE, whole).otherwise(F.struct(between.alias("center"), radius.alias("radius")))
