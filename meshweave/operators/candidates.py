"""Pairs of cells whose extents overlap, by an equi-join on bins instead of a nested loop.

Bins come in levels of doubling width.  A cell is put in the bins that its extent touches, at
the first level whose bins are at least as wide as it is (two bins an axis at most), and once more at each wider
level that the other grid's cells have; a pair meets at the wider one of its cells' levels.  So a cell takes a bounded
number of rows however much coarser or finer the other grid is.  Bins are squares in the
plane and, on a sphere, cubes in space (where there are neither poles nor a date line).

A pair is kept only in the first bin that both extents share, so no exchange is needed to drop duplicates.

Where many small cells meet at the level of a large one, one bin would gather them all.  Bins of more than ``FULL`` cells that
are small against them are split into halves along each axis, as often as the counts ask (a quadtree, or octree, that is deep where cells are dense); a large cell
goes to all of the parts that it touches.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.polygons import boxes_overlap, caps_overlap
from ..functions.shared import written
from ..sources.grid import Grid

#: Small cells in a bin beyond which it is split.
FULL = 8192
#: Cells narrower than this share of their distance from the origin are binned as if they were as wide.
LEAST_SHARE = 2.0**-40


def _boxes(grid: Grid, side: str) -> DataFrame:
    """id, ring, extent, and the lower and upper corner of the box to bin, names prefixed by ``side``."""
    cells = grid.extents().where(~grid.is_ghost())
    if grid.manifold.spherical:
        chord = 2 * F.sin(F.least(F.col("cap.radius"), F.lit(3.141592653589793)) / 2)
        low = [F.col(f"cap.center.{a}") - chord for a in "xyz"]
        high = [F.col(f"cap.center.{a}") + chord for a in "xyz"]
        own = [F.col("cap").alias(f"{side}cap")]
    else:
        low, high = [F.col("xmin"), F.col("ymin")], [F.col("xmax"), F.col("ymax")]
        own = [F.col(c).alias(f"{side}{c}") for c in ("xmin", "xmax", "ymin", "ymax")]
    return cells.select(F.col("cell_id").alias(f"{side}id"), F.col("ring").alias(f"{side}ring"), *own, F.array(*low).alias(f"{side}low"), F.array(*high).alias(f"{side}high"))


def _levelled(boxes: DataFrame, side: str, width: float | None) -> DataFrame:
    """Adds the level of each cell: its bins are ``width`` (or 1) times 2 ** level wide."""
    size = F.array_max(F.zip_with(f"{side}high", f"{side}low", lambda a, b: a - b))
    far = F.greatest(*[F.array_max(F.transform(c, F.abs)) for c in (f"{side}low", f"{side}high")])
    size = F.greatest(size, far * F.lit(LEAST_SHARE), F.lit(2.0**-900))
    level = F.ceil(F.log2(size / F.lit(width or 1.0)))
    return boxes.withColumn(f"{side}level", (F.greatest(level, F.lit(0)) if width else level).cast("int"))


def _levels(levelled: DataFrame, side: str) -> list[int]:
    """The levels that cells of a grid have: one for each doubling of their widths, so a short list."""
    return [r[0] for r in levelled.select(f"{side}level").where(f"{side}level IS NOT NULL").distinct().collect()]


def _wide(width: float | None, level: Column) -> Column:
    return F.lit(width or 1.0) * F.pow(F.lit(2.0), level)


def _binned(levelled: DataFrame, side: str, others: list[int], width: float | None, axes: int) -> DataFrame:
    """Adds level, depth (0) and the bins bin0, bin1 ... that a cell's box touches at each level where it meets others."""
    at = F.array_distinct(F.transform(F.array(*[F.lit(x) for x in others]), lambda x: F.greatest(x, F.col(f"{side}level"))))
    out = levelled.withColumn("level", F.explode(at)).withColumn("depth", F.lit(0))
    wide = _wide(width, F.col("level"))
    for k in range(axes):
        ends = [F.floor(F.get(f"{side}{end}", F.lit(k)) / wide).cast("bigint") for end in ("low", "high")]
        out = out.withColumn(f"bin{k}", F.explode(F.sequence(*ends)))
    return out


def _key(axes: int) -> list[str]:
    return ["level", "depth", *[f"bin{k}" for k in range(axes)]]


def _halved(rows: DataFrame, side: str, full: DataFrame, width: float | None, axes: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose bins are not in ``full``, and those that are, moved to the halves of their bins that their boxes touch."""
    same, moved = rows.join(full, _key(axes), "left_anti"), rows.join(full, _key(axes)).withColumn("depth", F.col("depth") + 1)
    wide = _wide(width, F.col("level") - F.col("depth"))
    for k in range(axes):
        low, high = (F.floor(F.get(f"{side}{end}", F.lit(k)) / wide).cast("bigint") for end in ("low", "high"))
        first = 2 * F.col(f"bin{k}")
        moved = moved.withColumn(f"bin{k}", F.explode(F.sequence(F.greatest(first, low), F.least(first + 1, high))))
    return same, written(moved.select(rows.columns))


def _split(a: DataFrame, b: DataFrame, width: float | None, axes: int, full: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with bins split until none has more than ``full`` cells that splitting can part."""
    key = _key(axes)

    def counted(rows: DataFrame, side: str, other: str) -> DataFrame:
        small = F.col(f"{side}level") < F.col("level") - F.col("depth")
        return rows.groupBy(*key).agg(F.count(F.lit(1)).alias(side), F.count(F.when(small, 1)).alias(f"{side}small"), F.lit(0).cast("bigint").alias(other), F.lit(0).cast("bigint").alias(f"{other}small"))

    done_a, done_b = [], []
    a, b = written(a), written(b)
    while True:
        both = counted(a, "dst_", "src_").unionByName(counted(b, "src_", "dst_")).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("dst_", "src_", "dst_small", "src_small")])
        # few: each stands for more than ``full`` rows
        found = written(both.where((F.col("dst_") > 0) & (F.col("src_") > 0) & (F.greatest("dst_small", "src_small") > full)).select(*key))
        if found.isEmpty():
            break
        (same_a, a), (same_b, b) = _halved(a, "dst_", found, width, axes), _halved(b, "src_", found, width, axes)
        done_a.append(same_a)
        done_b.append(same_b)
    return functools.reduce(DataFrame.unionByName, done_a, a), functools.reduce(DataFrame.unionByName, done_b, b)


def binned_pair(dst: Grid, src: Grid, *, width: float | None = None, full: int = FULL) -> tuple[DataFrame, DataFrame]:
    """The rows of both grids that are joined on level, depth and bins."""
    axes = 3 if dst.manifold.spherical else 2
    boxes = []
    for grid, side in ((dst, "dst_"), (src, "src_")):
        own = _boxes(grid, side)
        # corners and caps of a sphere, and parts of polygons, are computed once; a plane's boxes are a few comparisons
        boxes.append(_levelled(written(own) if grid.manifold.spherical or grid.kind == "parts" else own, side, width))
    a, b = boxes
    of_a, of_b = _levels(a, "dst_"), _levels(b, "src_")
    a, b = _binned(a, "dst_", of_b or [0], width, axes), _binned(b, "src_", of_a or [0], width, axes)
    # a bin has a cell once at most
    return (a, b) if _small(dst, src, full) else _split(a, b, width, axes, full)


def _small(dst: Grid, src: Grid, full: int) -> bool:
    return all(g.n_cells <= full and g.kind != "parts" for g in (dst, src))


def candidate_pairs(dst: Grid, src: Grid, *, width: float | None = None, full: int = FULL) -> DataFrame:
    """dst_id, dst_ring, src_id, src_ring of cells whose extents overlap, each pair once.

    ``width`` sets the narrowest bins and ``full`` when bins are split; the result does not depend on them; ghosts take no part.
    """
    spherical, axes = dst.manifold.spherical, 3 if dst.manifold.spherical else 2
    a, b = binned_pair(dst, src, width=width, full=full)
    # the planner takes rows with many bins and long rings for as small as the file they come from, and would send them through the driver
    joined = (a if _small(dst, src, full) else a.hint("merge")).join(b, _key(axes))
    overlap = caps_overlap(F.col("dst_cap"), F.col("src_cap")) if spherical else boxes_overlap("dst_", "src_")
    once: Column = (F.col("level") == F.greatest("dst_level", "src_level")) & overlap
    wide = _wide(width, F.col("level") - F.col("depth"))
    for k in range(axes):
        low = F.greatest(F.get("dst_low", F.lit(k)), F.get("src_low", F.lit(k)))
        once = once & (F.col(f"bin{k}") == F.floor(low / wide).cast("bigint"))
    return joined.where(once).select("dst_id", "dst_ring", "src_id", "src_ring")


def interval_overlaps(dst: DataFrame, src: DataFrame) -> DataFrame:
    """dst, src, length of intervals (k, low, high) that overlap, by the same join in one dimension."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        return _levelled(rows.select(F.col("k").alias(f"{name}id"), *[F.array(c).alias(f"{name}{c}") for c in ("low", "high")], F.col("low").alias(f"{name}from"), F.col("high").alias(f"{name}to")), name, None)

    a, b = side(dst, "dst_"), side(src, "src_")
    of_a, of_b = _levels(a, "dst_"), _levels(b, "src_")
    joined = _binned(a, "dst_", of_b or [0], None, 1).join(_binned(b, "src_", of_a or [0], None, 1), _key(1))
    low = F.floor(F.greatest("dst_from", "src_from") / _wide(None, F.col("level"))).cast("bigint")
    once = (F.col("level") == F.greatest("dst_level", "src_level")) & (F.col("bin0") == low)
    length = F.least("dst_to", "src_to") - F.greatest("dst_from", "src_from")
    return joined.where(once & (length > 0)).select(F.col("dst_id").alias("dst"), F.col("src_id").alias("src"), length.alias("length"))


def all_pairs(dst: Grid, src: Grid) -> DataFrame:
    """The same pairs by a nested loop, for grids of a few thousand cells at most."""
    a, b = _boxes(dst, "dst_"), _boxes(src, "src_")
    small = dst.n_cells if dst.n_cells <= src.n_cells else src.n_cells
    if small > 10_000:
        raise ValueError("a nested loop over these grids would be too long: use candidate_pairs")
    a, b = (F.broadcast(a), b) if small == dst.n_cells else (a, F.broadcast(b))
    overlap = caps_overlap(F.col("dst_cap"), F.col("src_cap")) if dst.manifold.spherical else boxes_overlap("dst_", "src_")
    joined = a.join(b, overlap)
    return joined.select("dst_id", "dst_ring", "src_id", "src_ring")
