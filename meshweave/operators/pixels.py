"""HEALPix numbers as join keys: regions are covered by pixels of mixed depth, points are found under their ancestors.

A region is where a point is within ``reach`` radians of each of its poles: a cap has one pole, a convex polygon a pole for
each edge with a quarter of a turn.  A pixel that lies in the region whole is an inner key, and what has it as ancestor needs no test; pixels on the
border are split into their four children down to ``depth``.  Keys are (level, number), so the join is an equi-join: neither cubes in
space nor a nested loop, and as many rows as the regions' borders have pixels.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import angles
from ..functions.points import clamp, cross, dot
from ..functions.polygons import following
from ..functions.shared import written
from ..sources.grids import JPLL, JRLL
from .merged import classed

#: Levels between the finest keys and the coarsest: a point has a key on each, and coarser inner pixels are split, so that no key gathers much of the sphere.
SPREAD = 3
#: A pixel's edges are no great circles; its cap is this much wider than its corners ask.
SLACK = 1.05
#: Regions covered at a time.
AT_ONCE = 256
POLES = "array<struct<x: double, y: double, z: double, reach: double>>"


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often its expression names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pixel_of(p: Column, level: int) -> Column:
    """Nested 0-based number of the pixel, of 12 * 4 ** level, that a unit vector lies in (Gorski et al. 2005)."""
    n = 1 << level

    def parts(s: Column) -> Column:
        z, turn = s["z"], s["turn"]
        # equatorial belt: lines that rise and fall; polar caps: distance from the pole, within a quarter
        rising, falling = (F.floor(n * (F.lit(0.5) + turn + sign * z * 0.75)) for sign in (-1, 1))
        one, other = F.floor(rising / n), F.floor(falling / n)
        belt = F.when(one == other, F.when(one == 4, 4).otherwise(one + 4)).when(one < other, one).otherwise(other + 8)
        quarter = F.least(F.floor(turn), F.lit(3))
        far = n * F.sqrt(3 * (1 - F.abs(z)))
        a, b = (F.least(F.floor(t * far), F.lit(n - 1)) for t in (turn - quarter, 1 - turn + quarter))
        in_belt, north = F.abs(z) <= 2 / 3, z > 0
        face = F.when(in_belt, belt).when(north, quarter).otherwise(quarter + 8)
        ix = F.when(in_belt, F.pmod(falling, F.lit(n))).when(north, n - 1 - b).otherwise(a)
        iy = F.when(in_belt, n - 1 - F.pmod(rising, F.lit(n))).when(north, n - 1 - a).otherwise(b)
        return F.named_struct(*[x for k, v in (("face", face), ("ix", ix), ("iy", iy)) for x in (F.lit(k), v.cast("bigint"))])

    def number(s: Column) -> Column:
        out = s["face"] * (n * n)
        for k in range(level):
            for value, place in ((s["ix"], 2 * k), (s["iy"], 2 * k + 1)):
                out = out + F.shiftleft(F.shiftright(value, k).bitwiseAND(F.lit(1).cast("bigint")), place)
        return out

    polar = F.struct(p["z"].alias("z"), F.pmod(F.atan2(p["y"], p["x"]) / (pi / 2), F.lit(4.0)).alias("turn"))
    return _once(_once(polar, parts), number)


def pixel_caps(pix: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Centers and radii of caps around pixels."""
    n, inner = 1 << level, pix & ((1 << 2 * level) - 1)
    face = pix >> (2 * level)
    ix, iy = np.zeros(len(pix)), np.zeros(len(pix))
    for k in range(level):
        ix += (inner >> (2 * k) & 1) << k
        iy += (inner >> (2 * k + 1) & 1) << k

    def point(dx: float, dy: float) -> np.ndarray:
        x, y = (ix + dx) / n, (iy + dy) / n
        down = np.array(JRLL)[face] - x - y
        ring = np.where(down < 1, down, np.where(down > 3, 4 - down, 1.0))
        z = np.where(down < 1, 1 - ring**2 / 3, np.where(down > 3, ring**2 / 3 - 1, (2 - down) * 2 / 3))
        phi = pi / 4 * np.mod(np.array(JPLL)[face] * ring + x - y, 8) / np.maximum(ring, 1e-300)
        flat = np.sqrt(np.maximum(1 - z * z, 0)) * (ring > 1e-14)
        return np.column_stack([flat * np.cos(phi), flat * np.sin(phi), z])

    center = point(0.5, 0.5)
    return center, SLACK * np.max([angles(center, point(dx, dy)) for dx in (0, 1) for dy in (0, 1)], axis=0)


def cover(poles: np.ndarray, reach: np.ndarray, depth: int, coarsest: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """level, region, pixel and whether it is inner, level by level, for regions (region, pole, xyz) and reaches (region, pole).

    The pixels of a region are disjoint; inner ones have at least level ``coarsest``.
    """
    region, pix = np.repeat(np.arange(len(poles)), 12), np.tile(np.arange(12), len(poles))
    for level in range(depth + 1):
        center, radius = pixel_caps(pix, level)
        away = angles(center[:, None], poles[region])
        some = (away - radius[:, None] <= reach[region]).all(axis=1)
        inner = ((away + radius[:, None] <= reach[region]) | (reach[region] >= pi)).all(axis=1) & (level >= coarsest)
        give = some & (inner | (level == depth))
        yield level, region[give], pix[give], inner[give]
        split = some & ~give
        region, pix = np.repeat(region[split], 4), (4 * pix[split][:, None] + np.arange(4)).ravel()


def cover_regions(regions: DataFrame, depth: int, coarsest: int = 0) -> DataFrame:
    """region_id, level, pix, inner: disjoint pixels that cover each region (region_id, poles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                sizes, flat = part.column("poles").value_lengths().to_numpy(), part.column("poles").flatten()
                poles, reach = np.zeros((part.num_rows, sizes.max(), 3)), np.full((part.num_rows, sizes.max()), 7.0)  # no pole: all is near
                at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                for k, axis in enumerate("xyz"):
                    poles[(*at, k)] = flat.field(axis).to_numpy()
                reach[at] = flat.field("reach").to_numpy()
                for level, region, pix, inner in cover(poles, reach, depth, coarsest):
                    yield pa.RecordBatch.from_arrays([part.column("region_id").take(pa.array(region)), pa.array(np.full(len(pix), level, np.int32)), pa.array(pix), pa.array(inner)], ["region_id", "level", "pix", "inner"])

    return regions.select(F.col("region_id").cast("bigint").alias("region_id"), "poles").where(F.size("poles") > 0).mapInArrow(run, "region_id bigint, level int, pix bigint, inner boolean")


def cap_poles(center: Column, radius: Column) -> Column:
    """Poles of a cap of ``radius`` radians."""
    return F.array(F.struct(*[center[a].cast("double").alias(a) for a in "xyz"], radius.cast("double").alias("reach")))


def polygon_poles(ring: Column) -> Column:
    """Poles of a convex, counterclockwise ring of unit vectors."""

    def pole(a: Column, b: Column) -> Column:
        n = cross(a, b)
        size = F.sqrt(dot(n, n))
        return F.struct(*[(n[k] / size).alias(k) for k in "xyz"], F.lit(pi / 2).alias("reach"))

    return F.zip_with(ring, following(ring), pole)


def _within() -> Column:
    return F.forall("poles", lambda p: F.acos(clamp(dot(p, F.col("point")))) <= p["reach"])


def points_in_regions(points: DataFrame, regions: DataFrame, depth: int = 6) -> DataFrame:
    """point_id, region_id of every point (point_id, point) in every region (region_id, poles).

    ``depth`` sets the finest keys, not the result; a region's border has about 2 ** depth pixels.
    """
    coarsest = max(0, depth - SPREAD)
    keys = cover_regions(regions, depth, coarsest)
    at = points.select("point_id", "point", pixel_of(F.col("point"), depth).alias("at"), F.explode(F.sequence(F.lit(coarsest), F.lit(depth))).alias("level"))
    keyed = at.withColumn("pix", F.expr(f"shiftright(at, 2 * ({depth} - level))")).drop("at")
    # the planner takes keys for as few as the regions they come from, and would send them through the driver
    met = keyed.join(keys.hint("merge"), ["level", "pix"]).select("point_id", "point", "region_id", "inner")
    tested = met.where("NOT inner").join(regions.select(F.col("region_id").cast("bigint").alias("region_id"), "poles"), "region_id")
    within = _within()
    return met.where("inner").select("point_id", "region_id").unionByName(tested.where(within).select("point_id", "region_id"))


def sums_in_regions(points: DataFrame, regions: DataFrame, depth: int = 6) -> DataFrame:
    """region_id, n, ids: the number of points in each region that has any, and the sum of their point_id.

    Equal points and equal regions are one.  What lies in inner pixels is added up pixel by pixel before it meets a region, so only points in the
    pixels of borders meet regions one by one, and no pair of them is moved.
    """
    coarsest = max(0, depth - SPREAD)
    regions, members = classed(regions.select(F.col("region_id").cast("bigint").alias("cell_id"), "poles"), ["poles"])
    keys = written(cover_regions(regions.select(F.col("of").alias("region_id"), "poles"), depth, coarsest).withColumnRenamed("region_id", "of"))
    sums = [F.sum("n").alias("n"), F.sum("ids").alias("ids")]
    places = points.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.sum("point_id").alias("ids")).withColumn("at", pixel_of(F.col("point"), depth))
    places = written(places)

    levels = places.groupBy("at").agg(*sums).withColumn("level", F.explode(F.sequence(F.lit(coarsest), F.lit(depth))))
    pixels = levels.groupBy("level", F.expr(f"shiftright(at, 2 * ({depth} - level))").alias("pix")).agg(*sums)
    whole = keys.where("inner").hint("merge").join(pixels, ["level", "pix"]).groupBy("of").agg(*sums)

    # keys of borders are all of the finest level
    border = keys.where("NOT inner").join(regions.hint("merge"), "of").select(F.col("pix").alias("at"), "of", "poles")
    tested = border.hint("merge").join(places, "at").where(_within()).groupBy("of").agg(*sums)
    found = whole.unionByName(tested).groupBy("of").agg(*sums)
    return found.join(members.withColumnRenamed("ids", "ids_of").hint("merge"), "of").select(F.explode("ids_of").alias("region_id"), "n", "ids")
