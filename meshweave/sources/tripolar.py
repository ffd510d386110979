"""Tripolar grids: latitude rows in the south, a cap with two poles on a latitude circle in the north (Murray 1996).

The cap is drawn in the stereographic plane, where the circle on which it joins the rows has
radius 1 and the poles are at (1, 0) and (-1, 0).  Rows are arcs through both poles, columns the
circles that meet them at right angles, so that both have closed forms.  The last row is the segment between the
poles; there column i meets column nx + 1 - i.
"""

from __future__ import annotations

from math import pi, radians, tan

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.points import unit_point
from ..manifold import sphere
from .grid import Grid, union_grids, with_ghosts
from .grids import _quads, fold_grid

#: Where the last row lies: its upper edges on the segment between the poles, or its centers.
FOLDS = ("edge", "center")


def cap_point(turn: Column, rise: Column, join: float, pole: float) -> Column:
    """Unit vector of a cap's point: ``turn`` (radians) along the joining circle from the first pole, ``rise`` from 0 there to 1 on the fold.

    Beyond the fold, up to 2, ``rise`` goes down on the other side.
    """
    flat = 1 + F.sin(rise * (pi / 2)) * F.abs(F.sin(turn))
    size = tan(radians(90 - join) / 2)
    a, b = F.cos(turn) / flat * size, F.cos(rise * (pi / 2)) * F.sin(turn) / flat * size
    c, s = F.cos(F.lit(radians(pole))), F.sin(F.lit(radians(pole)))
    x, y = a * c - b * s, a * s + b * c
    length = 1 + x * x + y * y
    return F.struct((2 * x / length).alias("x"), (2 * y / length).alias("y"), ((1 - x * x - y * y) / length).alias("z"))


def tripolar_grid(spark: SparkSession, nx: int, ny: int, cap: int, *, south: float = -80.0, join: float = 60.0, pole: float = 70.0, fold: str = "edge", radius: float = 1.0) -> Grid:
    """nx x ny cells; the last ``cap`` rows lie in the cap north of latitude ``join``, whose poles are at longitudes ``pole`` and 180 degrees further.

    With the fold through centers, the last row's ghosts are as in ``fold_grid``, and nx is a multiple of four.
    """
    if fold not in FOLDS:
        raise ValueError(f"fold is one of {FOLDS}")
    if nx % 2 or not 0 < cap < ny:
        raise ValueError("columns meet in pairs on the fold, and there are rows in the cap and south of it")
    rows, height = ny - cap, cap if fold == "edge" else cap - 0.5

    def corner(i: Column, j: Column) -> Column:
        below = unit_point(F.lit(float(pole)) + i * F.lit(360.0 / nx), F.lit(float(south)) + j * F.lit((join - south) / rows))
        return F.when(j <= rows, below).otherwise(cap_point(i * F.lit(2 * pi / nx), (j - rows) / F.lit(float(height)), join, pole))

    grid = Grid(_quads(spark, nx, ny, corner, once=True), (nx, ny), sphere(radius), "tripolar")
    return grid if fold == "edge" else fold_grid(grid)


def fold_sizes(nx: int, ny: int) -> list[int]:
    """Slots of the three parts of a grid folded through centers: all rows but the last, and the halves of that."""
    return [nx * (ny - 1), nx // 2, nx // 2]


def folded_parts(grid: Grid) -> Grid:
    """A grid folded through centers as a union of three parts; of each half of the last row the first half is real, ghosts fill its slots.

    Ids are those of ``fold_grid``; ``face`` numbers the parts.
    """
    nx, ny = grid.shape
    if nx % 4:
        raise ValueError("a folded row needs a number of cells that four divides")
    cells = grid.cells.drop("is_ghost")
    quarter, last = nx // 4, nx * (ny - 1)
    parts = [with_ghosts(Grid(cells.where(F.col("cell_id") <= last), (last,), grid.manifold), 0)]
    for start in (last, last + nx // 2):
        own = cells.where((F.col("cell_id") > start) & (F.col("cell_id") <= start + quarter)).withColumn("cell_id", F.col("cell_id") - start)
        parts.append(with_ghosts(Grid(own, (quarter,), grid.manifold), nx // 2 - quarter))
    return union_grids(parts, faces=True)
