"""Cells of equal geometry as one: pairs are looked for and clipped once for each pair of distinct cells, then given to all cells that they stand for.

``members`` (of, ids) has the cells of each class, at most ``AT_ONCE`` in a row, so no row grows with a class.  A cell is all rings of its id, so
classes share no cell and a pair of cells comes from one pair of classes.  Joins are shuffled: the planner cannot know how long arrays are, and would
send many classes and their members through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written
from ..sources.grid import Grid

#: Cells in a row of members.
AT_ONCE = 1024


@dataclass(frozen=True)
class Merged:
    """``grid``: a cell for each class, whose id is the class; ``members``: the cells of ``whole`` that it stands for."""

    grid: Grid
    members: DataFrame
    whole: Grid


def classed(cells: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Classes (of, key) of cells (cell_id, key), ids once each, and their members; null is a key as any other."""
    classes = written(cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.monotonically_increasing_id()))
    named = classes.select("of", "n", *[F.col(c).alias(f"__{c}") for c in key])
    match = F.lit(True)
    for c in key:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    part = F.pmod(F.xxhash64("cell_id"), F.ceil(F.col("n") / AT_ONCE))
    # an array of arrays keeps null ids
    members = cells.join(named.hint("merge"), match).groupBy("of", part.alias("part")).agg(F.flatten(F.collect_list(F.array("cell_id"))).alias("ids"))
    return classes.select("of", *key), written(members.select("of", "ids"))


def merged(grid: Grid) -> Merged:
    """The grid with cells of equal rings as one; ghosts, which meet no cell, are left out."""
    shape = [c for c in ("ring", "holes") if c in grid.cells.columns]
    cells = grid.cells.where(~grid.is_ghost()).select(F.col("cell_id").cast("bigint").alias("cell_id"), F.struct(*shape).alias("shape"))
    classes, members = classed(cells.groupBy("cell_id").agg(F.array_sort(F.collect_list("shape")).alias("shapes")), ["shapes"])
    rings = classes.select(F.col("of").alias("cell_id"), F.explode("shapes").alias("shape")).select("cell_id", "shape.*")
    return Merged(replace(grid, cells=rings, shape=(rings.count(),), axes=None), members, grid)


def common_classes(one: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (of, one, other) of cells that are together in both of two tables of members, and their members."""
    if one is other:
        return one.select("of", F.col("of").alias("one"), F.col("of").alias("other")).distinct(), one
    a, b = (m.select(F.col("of").alias(name), F.explode("ids").alias(f"{name}_id")) for m, name in ((one, "one"), (other, "other")))
    both = a.join(b, F.col("one_id").eqNullSafe(F.col("other_id")), "full")
    return classed(both.select(F.coalesce("one_id", "other_id").alias("cell_id"), "one", "other"), ["one", "other"])


def spread(pairs: DataFrame, members: dict[str, DataFrame | None]) -> DataFrame:
    """Rows of classes as rows of cells, for the columns that have members.

    Rows are dealt to tasks before they are spread: what is large is the rows that come of them, which nothing moves.
    """
    columns = pairs.columns
    for name, own in members.items():
        if own is not None:
            pairs = pairs.join(own.select(F.col("of").alias(name), F.col("ids").alias(f"__{name}")).hint("merge"), name)
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for name, own in members.items():
        if own is not None:
            kept = [c for c in pairs.columns if c not in (name, f"__{name}")]
            pairs = pairs.select(*kept, F.explode(f"__{name}").alias(name))
    return pairs.select(*columns)


def rounded(column: Column, digits: int | None) -> Column:
    return column if digits is None else F.round(column, digits)
