"""A space-filling order of a lattice's cells: neighbours along the curve share an edge, so ranges of it are compact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.grid import Grid


def _turned(x: Column, y: Column, rx: Column, ry: Column, last: Column) -> tuple[Column, Column]:
    """A quarter's own coordinates: the lower two are mirrored, the right one of them turned as well."""
    flip = (ry == 0) & (rx == 1)
    a, b = F.when(flip, last - x).otherwise(x), F.when(flip, last - y).otherwise(y)
    return F.when(ry == 0, b).otherwise(a), F.when(ry == 0, a).otherwise(b)


def hilbert_index(x: Column, y: Column, bits: int) -> Column:
    """Place along the Hilbert curve, from 0, of 0-based coordinates below 2 ** bits."""
    sides = F.array(*[F.lit(1 << k).cast("bigint") for k in reversed(range(bits))]) if bits else F.array().cast("array<bigint>")
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(s: Column, side: Column) -> Column:
        rx, ry = F.floor(s["x"] / side), F.floor(s["y"] / side)
        a, b = _turned(s["x"] - rx * side, s["y"] - ry * side, rx, ry, side - 1)
        quarter = F.when(rx == 0, ry).otherwise(3 - ry)
        return F.struct(a.cast("bigint").alias("x"), b.cast("bigint").alias("y"), (s["d"] * 4 + quarter).cast("bigint").alias("d"))

    return F.aggregate(sides, start, step)["d"]


def hilbert_point(d: Column, bits: int) -> tuple[Column, Column]:
    """The inverse: x and y of a place."""
    sides = F.array(*[F.lit(1 << k).cast("bigint") for k in range(bits)]) if bits else F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), d.cast("bigint").alias("d"))

    def step(s: Column, side: Column) -> Column:
        quarter = F.pmod(s["d"], F.lit(4))
        rx = F.when(quarter >= 2, 1).otherwise(0)
        ry = F.when((quarter == 1) | (quarter == 2), 1).otherwise(0)
        a, b = _turned(s["x"], s["y"], F.lit(0), ry, side - 1)
        flip = (ry == 0) & (rx == 1)
        a, b = F.when(flip, side - 1 - a).otherwise(a), F.when(flip, side - 1 - b).otherwise(b)
        return F.struct((a + rx * side).cast("bigint").alias("x"), (b + ry * side).cast("bigint").alias("y"), F.floor(s["d"] / 4).alias("d"))

    found = F.aggregate(sides, start, step)
    return found["x"], found["y"]


def along_the_curve(grid: Grid, side: int) -> DataFrame:
    """cell_id, new_id of a lattice of ``side`` x ``side`` cells, a power of two, or of several such faces one after another: for ``with_ids``."""
    if side < 1 or side & (side - 1):
        raise ValueError("the curve needs a power of two of cells along each axis")
    place = hilbert_index(F.col("i") - 1, F.col("j") - 1, side.bit_length() - 1)
    face = F.col("face") - 1 if "face" in grid.cells.columns else F.lit(0)
    return grid.cells.select("cell_id", (face * side * side + place + 1).cast("bigint").alias("new_id"))
