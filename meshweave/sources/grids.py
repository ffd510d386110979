"""Grid constructors.  Regular families are column expressions over ``spark.range``; corner tables come from the user."""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.points import normalized, planar_point, unit_point
from ..manifold import PLANAR, Manifold, sphere
from .grid import Axis, Grid, linear_to_cartesian, union_grids


def _edges(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def corners_once(places: list[Column], corner) -> Column:
    """The ring of ``corner`` at each place; its expression is in the plan once, and what reads a ring's points does not repeat it."""
    return F.transform(F.array(*places), corner)


def _quads(spark: SparkSession, nx: int, ny: int, corner, *, once: bool = False) -> DataFrame:
    """cell_id, i, j, ring of an (nx, ny) lattice; ``corner(i, j)`` gives the point of a 0-based lattice index.  ``once`` for long expressions."""
    i, j = linear_to_cartesian(F.col("cell_id"), nx)
    cells = spark.range(1, nx * ny + 1).select(F.col("id").alias("cell_id")).select("cell_id", i.alias("i"), j.alias("j"))
    a, b = F.col("i"), F.col("j")
    if once:
        places = [F.struct(x.alias("i"), y.alias("j")) for x, y in ((a - 1, b - 1), (a, b - 1), (a, b), (a - 1, b))]
        return cells.withColumn("ring", corners_once(places, lambda k: corner(k["i"], k["j"])))
    return cells.withColumn("ring", F.array(corner(a - 1, b - 1), corner(a, b - 1), corner(a, b), corner(a - 1, b)))


def regular_grid(spark: SparkSession, x, y, *, manifold: Manifold | None = None) -> Grid:
    """Outer product of two edge vectors; planar unless said otherwise (then x is longitude, y latitude)."""
    manifold = manifold or PLANAR
    if len(x) < 2 or len(y) < 2:
        raise ValueError("a regular grid needs two edges in each direction")
    xs, ys = _edges(x), _edges(y)
    point = unit_point if manifold.spherical else planar_point
    return Grid(_quads(spark, len(x) - 1, len(y) - 1, lambda i, j: point(F.get(xs, i), F.get(ys, j))), (len(x) - 1, len(y) - 1), manifold, "regular", (Axis(x), Axis(y)))


def uniform_grid(spark: SparkSession, nx: int, ny: int, x: tuple[float, float], y: tuple[float, float], *, manifold: Manifold | None = None) -> Grid:
    """As ``regular_grid`` with equal steps, computed in the cells: no edge vector in the plan, so any size will do."""
    manifold = manifold or PLANAR
    point = unit_point if manifold.spherical else planar_point

    def corner(i: Column, j: Column) -> Column:
        return point(F.lit(float(x[0])) + i * F.lit((x[1] - x[0]) / nx), F.lit(float(y[0])) + j * F.lit((y[1] - y[0]) / ny))

    axes = tuple(Axis(start=float(ends[0]), step=(ends[1] - ends[0]) / n, n=n) for ends, n in ((x, nx), (y, ny)))
    return Grid(_quads(spark, nx, ny, corner, once=manifold.spherical), (nx, ny), manifold, "regular", axes)


def latlon_grid(spark: SparkSession, nx: int, ny: int, *, lon: tuple[float, float] = (0.0, 360.0), lat: tuple[float, float] = (-90.0, 90.0), radius: float = 1.0) -> Grid:
    return uniform_grid(spark, nx, ny, lon, lat, manifold=sphere(radius))


def corner_grid(spark: SparkSession, corners, shape: tuple[int, int] | None = None, *, manifold: Manifold | None = None) -> Grid:
    """Cells between the points of a lattice.

    ``corners`` is an (nx+1, ny+1, 2 or 3) array, or a table i, j (1-based),
    point with ``shape`` = (nx, ny).  Points with three coordinates lie on the
    sphere; on a spherical manifold two coordinates are longitude and latitude.
    """
    if isinstance(corners, np.ndarray):
        nx, ny = corners.shape[0] - 1, corners.shape[1] - 1
        manifold = manifold or (sphere() if corners.shape[2] == 3 else PLANAR)
        rows = [(i + 1, j + 1, *map(float, corners[i, j])) for i in range(nx + 1) for j in range(ny + 1)]
        names = ["i", "j", *(("x", "y", "z") if corners.shape[2] == 3 else ("x", "y"))]
        table = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n in 'ij' else 'double'}" for n in names))
        if corners.shape[2] == 3:
            point = F.struct("x", "y", "z")
        else:
            point = unit_point(F.col("x"), F.col("y")) if manifold.spherical else planar_point(F.col("x"), F.col("y"))
        table = table.select("i", "j", point.alias("point"))
    else:
        table, (nx, ny) = corners, shape
        manifold = manifold or PLANAR
    # each corner belongs to up to four cells; one exchange puts a cell's corners together
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j")) for k, (di, dj) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]))
    spread = table.select(places.alias("p"), "point").where(F.col("p.i").between(1, nx) & F.col("p.j").between(1, ny))
    rings = spread.groupBy(F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.array_sort(F.collect_list(F.struct(F.col("p.k").alias("k"), "point"))).alias("c"))
    cells = rings.select((F.col("i") + (F.col("j") - 1).cast("bigint") * nx).alias("cell_id"), "i", "j", F.transform("c", lambda e: e["point"]).alias("ring"))
    return Grid(cells, (nx, ny), manifold, "corners")


def polygon_grid(spark: SparkSession, polygons, *, manifold: Manifold | None = None) -> Grid:
    """One cell for each polygon, in order.

    A polygon is a ring of points, closed or open, or {"exterior": ring,
    "holes": [rings]} in the plane; or ``polygons`` is a table cell_id, ring.
    """
    manifold = manifold or PLANAR
    if isinstance(polygons, DataFrame):
        return Grid(polygons, (polygons.count(),), manifold, "polygons")

    def ring(points) -> list[tuple]:
        points = [tuple(map(float, p)) for p in points]
        return points[:-1] if len(points) > 1 and points[0] == points[-1] else points

    rows = []
    for number, p in enumerate(polygons, 1):
        p = p if isinstance(p, dict) else {"exterior": p, "holes": []}
        rows.append((number, ring(p["exterior"]), [ring(h) for h in p.get("holes", [])]))
    n = len(rows[0][1][0]) if rows and rows[0][1] else 2
    point = "struct<x: double, y: double, z: double>" if n == 3 else "struct<x: double, y: double>"
    cells = spark.createDataFrame(rows, f"cell_id bigint, ring array<{point}>, holes array<array<{point}>>")
    if manifold.spherical:
        cells = cells.drop("holes")
        if n == 2:
            cells = cells.withColumn("ring", F.transform("ring", lambda p: unit_point(p["x"], p["y"])))
    return Grid(cells, (len(rows),), manifold, "polygons")


def rotated_latlon_grid(spark: SparkSession, nx: int, ny: int, pole: tuple[float, float], *, lon: tuple[float, float] = (0.0, 360.0), lat: tuple[float, float] = (-90.0, 90.0), radius: float = 1.0) -> Grid:
    """A longitude-latitude grid whose north pole is turned to ``pole``."""
    grid = latlon_grid(spark, nx, ny, lon=lon, lat=lat, radius=radius)
    a, b = np.radians(pole[0]), np.radians(90 - pole[1])
    turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]) @ np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])

    def turned(p: Column) -> Column:
        return F.struct(*[(p["x"] * float(r[0]) + p["y"] * float(r[1]) + p["z"] * float(r[2])).alias(n) for r, n in zip(turn, "xyz", strict=True)])

    return Grid(grid.cells.withColumn("ring", F.transform("ring", turned)), grid.shape, grid.manifold, "rotated")


def ring_grid(spark: SparkSession, latd, nlon: int | list[int], *, lon0: float = 0.0, radius: float = 1.0) -> Grid:
    """Full rings of equal longitudes at latitudes ``latd``, north to south; ids run along the rings.

    Latitude edges lie half way between rings and at the poles; ``lon0`` is the first center.
    Rings of different lengths (reduced grids) are not supported.
    """
    if not isinstance(nlon, int):
        if len(set(nlon)) != 1:
            raise ValueError("reduced ring grids are not supported: all rings need as many points")
        nlon = nlon[0]
    latd = [float(v) for v in latd]
    nlat = len(latd)
    edges = _edges([90.0, *[(a + b) / 2 for a, b in zip(latd, latd[1:], strict=False)], -90.0])
    step = 360.0 / nlon

    def corner(i: Column, j: Column) -> Column:  # j runs south to north
        return unit_point(F.lit(lon0 - step / 2) + i * F.lit(step), F.get(edges, F.lit(nlat) - j))

    cells = _quads(spark, nlon, nlat, corner, once=True)
    ring = F.lit(nlat + 1) - F.col("j")
    cells = cells.withColumn("cell_id", (ring - 1).cast("bigint") * nlon + F.col("i"))
    return Grid(cells, (nlon * nlat,), sphere(radius), "rings")


#: Fixed values of the published HEALPix base layout: ring and longitude numbers of the twelve faces.
JRLL = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
JPLL = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)


def _even_bits(x: Column, levels: int) -> Column:
    out = F.lit(0).cast("bigint")
    for k in range(levels):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, 2 * k).bitwiseAND(F.lit(1).cast("bigint")), k))
    return out


def healpix_nested_to_ring(pix: Column, nside: int) -> Column:
    """0-based nested to 0-based ring number (Gorski et al. 2005)."""
    face, ix, iy = healpix_parts(pix, nside)
    jrll, jpll = (F.get(F.array(*map(F.lit, v)), face.cast("int")) for v in (JRLL, JPLL))
    jr = jrll * nside - ix - iy - 1
    north, south = jr < nside, jr > 3 * nside
    nr = F.when(north, jr).when(south, 4 * nside - jr).otherwise(nside)
    before = F.when(north, 2 * nr * (nr - 1)).when(south, 12 * nside * nside - 2 * nr * (nr + 1)).otherwise(2 * nside * (nside - 1) + (jr - nside) * 4 * nside)
    shift = F.when(north | south, 0).otherwise(F.pmod(jr - nside, F.lit(2)))
    jp = F.floor((jpll * nr + ix - iy + 1 + shift) / 2)
    jp = F.pmod(jp - 1, 4 * nr) + 1
    return (before + jp - 1).cast("bigint")


def healpix_parts(pix: Column, nside: int) -> tuple[Column, Column, Column]:
    """Face and, within it, ix and iy of a 0-based nested number."""
    levels = max(1, nside.bit_length() - 1)
    inner = F.pmod(pix, F.lit(nside * nside))
    return F.floor(pix / (nside * nside)), _even_bits(inner, levels), _even_bits(F.shiftright(inner, 1), levels)


def healpix_grid(spark: SparkSession, nside: int, *, order: str = "nested", radius: float = 1.0) -> Grid:
    """12 nside^2 quadrilaterals with great-circle edges; ids are 1-based in either order."""
    if nside < 1 or nside & (nside - 1):
        raise ValueError("nside is a power of two")
    if order not in ("nested", "ring"):
        raise ValueError("order is nested or ring")
    pix = F.col("pix")
    face, ix, iy = healpix_parts(pix, nside)
    table = spark.range(12 * nside * nside).select(F.col("id").alias("pix")).select("pix", face.cast("int").alias("f"), ix.cast("double").alias("ix"), iy.cast("double").alias("iy"))
    jrll, jpll = (F.get(F.array(*[F.lit(float(n)) for n in v]), F.col("f")) for v in (JRLL, JPLL))

    def corner(at: Column) -> Column:
        x, y = at["x"] / nside, at["y"] / nside
        jr = jrll - x - y
        nr = F.when(jr < 1, jr).when(jr > 3, 4 - jr).otherwise(F.lit(1.0))
        z = F.when(jr < 1, 1 - nr * nr / 3).when(jr > 3, nr * nr / 3 - 1).otherwise((2 - jr) * 2 / 3)
        turn = F.when(nr < 1e-14, 0.0).otherwise(F.pmod(jpll * nr + x - y, F.lit(8.0)) / F.when(nr < 1e-14, 1.0).otherwise(nr))
        phi, flat = turn * (pi / 4), F.sqrt(F.greatest(1 - z * z, F.lit(0.0)))
        return F.struct((flat * F.cos(phi)).alias("x"), (flat * F.sin(phi)).alias("y"), z.alias("z"))

    number = pix if order == "nested" else healpix_nested_to_ring(pix, nside)
    ring = corners_once([F.struct((F.col("ix") + dx).alias("x"), (F.col("iy") + dy).alias("y")) for dx, dy in ((1, 1), (0, 1), (0, 0), (1, 0))], corner)
    return Grid(table.select((number + 1).alias("cell_id"), (F.col("f") + 1).alias("face"), ring.alias("ring")), (12 * nside * nside,), sphere(radius), "healpix")


#: Centers and right-handed axes of the six faces.
CUBE = (((1, 0, 0), (0, 1, 0), (0, 0, 1)), ((0, 1, 0), (-1, 0, 0), (0, 0, 1)), ((-1, 0, 0), (0, -1, 0), (0, 0, 1)), ((0, -1, 0), (1, 0, 0), (0, 0, 1)), ((0, 0, 1), (0, 1, 0), (-1, 0, 0)), ((0, 0, -1), (0, 1, 0), (1, 0, 0)))


def cubed_sphere(spark: SparkSession, ne: int, *, radius: float = 1.0) -> Grid:
    """Six faces of ne x ne cells, equiangular gnomonic (Ronchi et al. 1996)."""
    parts = []
    for center, e1, e2 in CUBE:

        def corner(i: Column, j: Column, center=center, e1=e1, e2=e2) -> Column:
            u, v = (F.tan((i * (2.0 / ne) - 1.0) * (pi / 4)), F.tan((j * (2.0 / ne) - 1.0) * (pi / 4)))
            return normalized(F.struct(*[(F.lit(float(c)) + u * float(a) + v * float(b)).alias(n) for c, a, b, n in zip(center, e1, e2, "xyz", strict=True)]))

        parts.append(Grid(_quads(spark, ne, ne, corner, once=True), (ne, ne), sphere(radius)))
    grid = union_grids(parts, faces=True)
    return Grid(grid.cells, grid.shape, grid.manifold, "cubed")


def fold_grid(grid: Grid) -> Grid:
    """A grid whose last row is folded on itself at the center (tripolar grids).

    Of the last row the first and third quarters are real cells; the others are ghosts, the mirror images of those.
    """
    nx, ny = grid.shape
    if nx % 4:
        raise ValueError("a folded row needs a number of cells that four divides")
    quarter, half = nx // 4, nx // 2
    real = F.col("i").between(1, quarter) | F.col("i").between(half + 1, half + quarter)
    return Grid(grid.cells.withColumn("is_ghost", (F.col("j") == ny) & ~real), grid.shape, grid.manifold, "fold")
