"""Registered queries: the library's operators on the test tables, with DuckDB SQL for each where SQL can say it.

Axes come from the tables' numbers: lineitem by quantity and discount, parts by size and
price, customers hashed to longitudes and latitudes.  Edges are multiples of powers of two and counts are integers where
results are compared exactly; other results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields, polygons
from ..functions.points import unit_point
from ..manifold import sphere
from ..operators.candidates import candidate_pairs
from ..operators.merged import merged, spread
from ..operators.metrics import average_coincident, error_metrics, integral, mirror_fold
from ..operators.regridder import Regridder, build_regridder
from ..sources import as_grid, cubed_sphere, healpix_grid, latlon_grid, regular_grid, ring_grid, rotated_latlon_grid, union_grids
from ..sources.grid import Grid, part_of
from ..sources.grids import healpix_nested_to_ring, healpix_parts, uniform_grid
from ..sources.weights_io import esmf_tables

#: 52 x 12 unit cells over quantity and hundredths of discount, and a coarser, shifted grid that goes beyond them.
FINE_X, FINE_Y = list(range(0, 53)), list(range(-1, 12))
COARSE_X, COARSE_Y = [k * 3.5 for k in range(0, 17)], [k * 2.25 - 2 for k in range(0, 8)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fine_cell(quantity, discount):
    i = F.floor(quantity) + 1
    j = F.floor(F.round(discount * 100)) + 2
    return (i + (j - 1) * (len(FINE_X) - 1)).cast("bigint")


def lineitem_field(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """Number of items in each fine cell."""
    rows = table(spark, sf_dir, "lineitem").select(fine_cell(F.col("l_quantity"), F.col("l_discount")).alias("cell_id"), *by)
    return rows.groupBy("cell_id", *by).agg(F.count(F.lit(1)).alias("value"))


def lineitem_regridder(spark: SparkSession) -> Regridder:
    return build_regridder(regular_grid(spark, COARSE_X, COARSE_Y), regular_grid(spark, FINE_X, FINE_Y))


def regrid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_regridder(spark).regrid(lineitem_field(spark, sf_dir))


def regrid_items_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_regridder(spark).regrid(lineitem_field(spark, sf_dir), normalize=False)


def regrid_items_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_regridder(spark).regrid(lineitem_field(spark, sf_dir, "l_returnflag"), by="l_returnflag")


def regrid_items_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = lineitem_regridder(spark)
    back = there.transpose().regrid(there.regrid(lineitem_field(spark, sf_dir)))
    return back.select("cell_id", F.round("value", 6).alias("value"))


def occupied_regridder(spark: SparkSession, sf_dir: str) -> Regridder:
    """The same grids, of whose fine cells only those with items are there."""
    fine = regular_grid(spark, FINE_X, FINE_Y)
    cells = fine.cells.join(lineitem_field(spark, sf_dir), "cell_id", "left_semi")
    return build_regridder(regular_grid(spark, COARSE_X, COARSE_Y), Grid(cells, fine.shape, fine.manifold))


def overlap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of cells that have items, with the items' numbers."""
    field = lineitem_field(spark, sf_dir).withColumnRenamed("cell_id", "src")
    return occupied_regridder(spark, sf_dir).weights.join(field, "src").select("dst", "src", F.round("area", 9).alias("area"), "value")


def normalized_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = occupied_regridder(spark, sf_dir).normalize()
    return r.weights.select("dst", "src", F.round("area", 9).alias("area"))


def overlap_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each cell lies under cells of the other side that have items, or, of theirs, over any."""
    found = zip(("dst", "src"), occupied_regridder(spark, sf_dir).marginals(), strict=True)
    dst, src = (t.select(F.lit(side).alias("side"), "cell_id", *[F.round(c, 9).alias(c) for c in ("area", "total", "frac")]) for side, t in found)
    return dst.unionByName(src)


def covered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse cells under cells with items."""
    return occupied_regridder(spark, sf_dir).covered()


def conserved_integrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, field = lineitem_regridder(spark), lineitem_field(spark, sf_dir)
    there = integral(r.regrid(field), r.dst_areas).select(F.lit("dst").alias("side"), F.round("integral", 6).alias("integral"))
    return there.unionByName(integral(field, r.src_areas).select(F.lit("src").alias("side"), F.round("integral", 6).alias("integral")))


def esmf_weight_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weights, those of cells without items too, with the number of items that each applies to."""
    weights, _, _ = esmf_tables(lineitem_regridder(spark))
    field = lineitem_field(spark, sf_dir).withColumnRenamed("cell_id", "col")
    return weights.join(field, "col", "left").select("row", "col", "S", F.coalesce("value", F.lit(0)).alias("value"))


def regrid_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lineitem_regridder(spark)
    field = lineitem_field(spark, sf_dir)
    back = r.transpose().regrid(r.regrid(field))
    return error_metrics(back, field).select(F.round("max_misfit", 6).alias("max_misfit"), F.round("mean_misfit", 6).alias("mean_misfit"), F.round("rms_misfit", 6).alias("rms_misfit"))


def part_boxes(spark: SparkSession, sf_dir: str, width: float, height: float):
    """A rectangle for each part, by size and price, as a table that makes a grid."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("cell_id"), F.col("p_size").cast("double").alias("x"), F.floor(F.col("p_retailprice").cast("double")).alias("y"))
    ring = F.array(*[F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y")) for dx, dy in ((0, 0), (width, 0), (width, height), (0, height))])
    return part.select("cell_id", ring.alias("ring"))


def overlapping_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial join of two sets of rectangles that form no lattice."""
    from ..sources import polygon_grid

    a, b = (merged(polygon_grid(spark, part_boxes(spark, sf_dir, w, h))) for w, h in ((0.5, 2.5), (1.25, 1.5)))
    pairs = candidate_pairs(a.grid, b.grid, width=4.0).select("dst_id", "src_id")
    return spread(pairs, {"dst_id": a.members, "src_id": b.members})


def part_overlap_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with the areas of their polygons' intersections, by the clipping kernel."""
    from ..sources import polygon_grid

    a, b = (merged(polygon_grid(spark, part_boxes(spark, sf_dir, w, h))) for w, h in ((0.5, 2.5), (1.25, 1.5)))
    return build_regridder(a, b, width=4.0).rounded(6)


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (F.pmod(k * 37, F.lit(360)) - 180).cast("double").alias("lon"), (F.pmod(k * 53, F.lit(179)) - 89).cast("double").alias("lat"))


def customers_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the cells of a longitude-latitude grid of ten degrees."""
    i, j = F.floor(F.pmod(F.col("lon"), F.lit(360.0)) / 10), F.least(F.floor((F.col("lat") + 90) / 10), F.lit(17))
    return customer_points(spark, sf_dir).groupBy((i + 1 + j * 36).cast("bigint").alias("cell_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def example_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    found = {"longitude": fields.longitude_field(), "sinusoid": fields.sinusoid_field(), "harmonic": fields.harmonic_field(), "gulf_stream": fields.gulf_stream_field(), "vortex": fields.vortex_field()}
    return customer_points(spark, sf_dir).select("id", *[F.round(f(lon, lat), 6).alias(n) for n, f in found.items()])


def customer_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solid angles of triangles at the customers' points."""
    lon, lat = F.col("lon"), F.col("lat")
    ring = F.array(unit_point(lon, lat), unit_point(lon + 10, lat), unit_point(lon, F.least(lat + 10, F.lit(90.0))))
    return customer_points(spark, sf_dir).select("id", F.round(polygons.spherical_area(ring), 9).alias("area"))


def part_polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shoelace areas of a quadrilateral for each part."""
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((F.lit(0.0), F.lit(0.0)), (x, F.lit(1.0)), (x + 2, y), (F.lit(-1.0), y / 2))])
    return table(spark, sf_dir, "part").select("p_partkey", F.round(polygons.planar_area(ring), 6).alias("area"))


def latlon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of longitude-latitude cells with great-circle edges, and the customers in them."""
    found = latlon_grid(spark, 36, 18).areas().join(customers_by_cell(spark, sf_dir), "cell_id")
    return found.select("cell_id", F.round("area", 9).alias("area"), "value")


def healpix_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and ring numbers of a pixel for each customer."""
    pix = F.col("pix")
    face, ix, iy = healpix_parts(pix, 8)
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.pmod(F.col("c_custkey") * 37, F.lit(768)).cast("bigint").alias("pix"))
    return customers.select("c_custkey", pix.alias("nested"), face.cast("bigint").alias("face"), ix.alias("ix"), iy.alias("iy"), healpix_nested_to_ring(pix, 8).alias("ring"))


def ring_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in a ring grid's cells, with the cells' heights from their corners; ids run north to south."""
    grid = ring_grid(spark, [67.5, 22.5, -22.5, -67.5], 8)
    z = F.aggregate("ring", F.lit(0.0), lambda s, p: s + p["z"]) / 4
    i, j = F.floor(F.pmod(F.col("lon") + 22.5, F.lit(360.0)) / 45), F.least(F.floor((F.col("lat") + 90) / 45), F.lit(3))
    counts = customer_points(spark, sf_dir).groupBy(((3 - j) * 8 + i + 1).cast("bigint").alias("cell_id")).agg(F.count(F.lit(1)).alias("n"))
    return grid.cells.join(counts, "cell_id").select("cell_id", "i", "j", F.round(z, 9).alias("z"), "n")


def offset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids one after another: boxes of parts, a lattice and boxes of parts again; ids, areas, and the part that an id is in."""
    from ..sources import polygon_grid

    boxes = lambda w, h: polygon_grid(spark, part_boxes(spark, sf_dir, w, h).withColumn("cell_id", F.col("cell_id") + 1))  # noqa: E731, keys begin at 0
    parts = [boxes(0.5, 2.5), regular_grid(spark, [2, 4], [0, 1.5]), boxes(1.25, 1.5)]
    part, local = part_of(F.col("cell_id"), [p.n_cells for p in parts])
    return union_grids(parts, faces=True).areas().select("cell_id", F.round("area", 9).alias("area"), part.alias("part"), local.alias("local"))


def folded_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts on a lattice of 8 x 7 whose last row is folded: ghosts get the values of their twins."""
    cell = (F.pmod(F.col("o_custkey"), F.lit(56)) + 1).cast("bigint")
    field = table(spark, sf_dir, "orders").groupBy(cell.alias("cell_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return mirror_fold(field, 8, 7)


def shared_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means over coincident nodes: suppliers of one nation share a node."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").alias("global_node"), F.floor("s_acctbal").cast("double").alias("value"), (F.pmod("s_suppkey", F.lit(4)) + 1).cast("double").alias("weight"))
    return average_coincident(rows).select("node_id", F.round("value", 6).alias("value"))


def regrid_spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer counts on a longitude-latitude grid, conserved on HEALPix, cubed-sphere, rotated and ring grids."""
    src = latlon_grid(spark, 36, 18)
    field = customers_by_cell(spark, sf_dir)
    out = None
    for name, dst in (("healpix", healpix_grid(spark, 4)), ("cubed", cubed_sphere(spark, 5)), ("rotated", rotated_latlon_grid(spark, 20, 10, (40.0, 60.0))), ("rings", ring_grid(spark, [67.5, 22.5, -22.5, -67.5], 8))):
        r = build_regridder(dst, src)
        one = integral(r.regrid(field), r.dst_areas).select(F.lit(name).alias("grid"), F.round("integral", 6).alias("integral"))
        out = one if out is None else out.unionByName(one)
    return out


def dispatched_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge vectors are a planar grid; on a sphere they are longitudes and latitudes.  Customers by cell."""
    edges = [0.0, 90.0, 180.0], [0.0, 45.0, 90.0]
    cell = F.floor(F.col("lon") / 90) + 1 + F.floor(F.col("lat") / 45) * 2
    counts = customer_points(spark, sf_dir).where("lon BETWEEN 0 AND 179 AND lat >= 0").groupBy(cell.cast("bigint").alias("cell_id")).agg(F.count(F.lit(1)).alias("n"))
    found = None
    for kind, manifold in (("planar", None), ("spherical", sphere())):
        one = as_grid(edges, spark, manifold).areas().join(counts, "cell_id").select(F.lit(kind).alias("kind"), "cell_id", F.round("area", 9).alias("area"), "n")
        found = one if found is None else found.unionByName(one)
    return found


def regrid_large_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on 480,000 cells, and on 120,000: build and apply, binned join and sums in the JVM."""
    dst = uniform_grid(spark, 400, 300, (0.0, 800.0), (0.0, 600.0))
    src = uniform_grid(spark, 800, 600, (0.0, 800.0), (0.0, 600.0))
    cell = F.pmod(F.col("o_orderkey").cast("bigint") * 7919, F.lit(480_000)) + 1
    field = table(spark, sf_dir, "orders").groupBy(cell.alias("cell_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return build_regridder(dst, src).regrid(field)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (regrid_items, regrid_items_sums, regrid_items_by_flag, regrid_items_and_back, overlap_weights, normalized_weights, overlap_fractions, covered_cells, conserved_integrals, esmf_weight_table, regrid_errors, overlapping_parts, part_overlap_areas, example_fields, customer_triangles, part_polygon_areas, latlon_areas, healpix_numbers, ring_grid_cells, offset_union, folded_row, shared_nodes, regrid_spheres, dispatched_grid, regrid_large_lattice)}

_GRIDS = """
WITH fine AS (SELECT (i + 1 + j * 52)::BIGINT AS id, i::DOUBLE AS x0, (i + 1)::DOUBLE AS x1, (j - 1)::DOUBLE AS y0, j::DOUBLE AS y1 FROM range(52) a(i), range(12) b(j)),
coarse AS (SELECT (i + 1 + j * 16)::BIGINT AS id, i * 3.5::DOUBLE AS x0, (i + 1) * 3.5::DOUBLE AS x1, j * 2.25::DOUBLE - 2 AS y0, (j + 1) * 2.25::DOUBLE - 2 AS y1 FROM range(16) a(i), range(7) b(j)),
w AS (
  SELECT c.id AS dst, f.id AS src, (least(c.x1, f.x1) - greatest(c.x0, f.x0)) * (least(c.y1, f.y1) - greatest(c.y0, f.y0)) AS area
  FROM coarse c JOIN fine f ON c.x0 < f.x1 AND f.x0 < c.x1 AND c.y0 < f.y1 AND f.y0 < c.y1),
da AS (SELECT id AS cell_id, (x1 - x0) * (y1 - y0) AS area FROM coarse),
sa AS (SELECT id AS cell_id, (x1 - x0) * (y1 - y0) AS area FROM fine),
items AS (SELECT *, (floor(l_quantity) + 1 + (floor(round(l_discount * 100)) + 1) * 52)::BIGINT AS cell_id FROM lineitem),
field AS (SELECT cell_id, count(*)::DOUBLE AS value FROM items GROUP BY 1),
there AS (
  SELECT da.cell_id, coalesce(sum(w.area * f.value), 0) / any_value(da.area) AS value
  FROM da LEFT JOIN w ON w.dst = da.cell_id LEFT JOIN field f ON f.cell_id = w.src GROUP BY 1),
back AS (
  SELECT sa.cell_id, coalesce(sum(w.area * t.value), 0) / any_value(sa.area) AS value
  FROM sa LEFT JOIN w ON w.src = sa.cell_id LEFT JOIN there t ON t.cell_id = w.dst GROUP BY 1)
"""

_POINTS = "WITH p AS (SELECT c_custkey AS id, ((c_custkey * 37) % 360 - 180)::DOUBLE AS lon, ((c_custkey * 53) % 179 - 89)::DOUBLE AS lat FROM customer)\n"


def _excess(a: str, b: str, c: str) -> str:
    """Solid angle of the triangle of three xyz structs."""
    dot = lambda u, v: f"({u}.x * {v}.x + {u}.y * {v}.y + {u}.z * {v}.z)"
    triple = f"({a}.x * ({b}.y * {c}.z - {b}.z * {c}.y) + {a}.y * ({b}.z * {c}.x - {b}.x * {c}.z) + {a}.z * ({b}.x * {c}.y - {b}.y * {c}.x))"
    return f"2 * atan2({triple}, 1 + {dot(a, b)} + {dot(b, c)} + {dot(c, a)})"


def _unit(lon: str, lat: str) -> str:
    return f"{{'x': cos(radians({lat})) * cos(radians({lon})), 'y': cos(radians({lat})) * sin(radians({lon})), 'z': sin(radians({lat}))}}"


def _quad_areas(cells: str) -> str:
    """cell_id, area of longitude-latitude quadrilaterals (cell_id, a0, a1, b0, b1)."""
    corners = ", ".join(f"{_unit(a, b)} AS {n}" for n, a, b in (("p", "a0", "b0"), ("q", "a1", "b0"), ("r", "a1", "b1"), ("s", "a0", "b1")))
    return f"SELECT cell_id, round(abs({_excess('p', 'q', 'r')} + {_excess('p', 'r', 's')}), 9) AS area FROM (SELECT cell_id, {corners} FROM ({cells}))"


_BOXES = """
WITH b AS (SELECT p_partkey::BIGINT AS id, p_size::DOUBLE AS x, floor(p_retailprice::DOUBLE) AS y FROM part),
d AS (SELECT id, x AS x0, x + 0.5::DOUBLE AS x1, y AS y0, y + 2.5::DOUBLE AS y1 FROM b),
s AS (SELECT id, x AS x0, x + 1.25::DOUBLE AS x1, y AS y0, y + 1.5::DOUBLE AS y1 FROM b)
"""

_TENS = "SELECT (i + 1 + j * 36)::BIGINT AS cell_id, i * 10::DOUBLE AS a0, (i + 1) * 10::DOUBLE AS a1, j * 10::DOUBLE - 90 AS b0, (j + 1) * 10::DOUBLE - 90 AS b1 FROM range(36) x(i), range(18) y(j)"
_BY_CELL = ", f AS (SELECT (floor(((lon + 360) % 360) / 10) + 1 + least(floor((lat + 90) / 10), 17) * 36)::BIGINT AS cell_id, count(*)::DOUBLE AS value FROM p GROUP BY 1)"

_SINUSOID = "2 - cos(pi() * acos(greatest(least(cos(radians(lon)) * cos(radians(lat)), 1), -1)) / (1.2::DOUBLE * pi()))"

ORACLE_SQL: dict[str, str] = {
    "regrid_items": _GRIDS + "SELECT cell_id, value FROM there",
    "regrid_items_sums": _GRIDS + "SELECT da.cell_id, coalesce(sum(w.area * f.value), 0) AS value FROM da LEFT JOIN w ON w.dst = da.cell_id LEFT JOIN field f ON f.cell_id = w.src GROUP BY 1",
    "regrid_items_by_flag": _GRIDS + """, flags AS (SELECT DISTINCT l_returnflag FROM lineitem), f2 AS (SELECT cell_id, l_returnflag, count(*)::DOUBLE AS value FROM items GROUP BY 1, 2),
sums AS (SELECT w.dst, f2.l_returnflag, sum(w.area * f2.value) AS value FROM w JOIN f2 ON f2.cell_id = w.src GROUP BY 1, 2)
SELECT da.cell_id, g.l_returnflag, coalesce(s.value, 0) / da.area AS value FROM da CROSS JOIN flags g LEFT JOIN sums s ON s.dst = da.cell_id AND s.l_returnflag IS NOT DISTINCT FROM g.l_returnflag""",
    "regrid_items_and_back": _GRIDS + "SELECT cell_id, round(value, 6) AS value FROM back",
    "overlap_weights": _GRIDS + "SELECT dst, src, round(area, 9) AS area, count(*) AS value FROM w JOIN items ON items.cell_id = w.src GROUP BY dst, src, area",
    "normalized_weights": _GRIDS + ", o AS (SELECT w.* FROM w SEMI JOIN field ON field.cell_id = w.src) SELECT dst, src, round(area / (SELECT max(area) FROM o), 9) AS area FROM o",
    "overlap_fractions": _GRIDS + """, o AS (SELECT w.* FROM w SEMI JOIN field ON field.cell_id = w.src)
SELECT 'dst' AS side, da.cell_id, round(any_value(da.area), 9) AS area, round(coalesce(sum(o.area), 0), 9) AS total, round(coalesce(sum(o.area), 0) / any_value(da.area), 9) AS frac FROM da LEFT JOIN o ON o.dst = da.cell_id GROUP BY 2
UNION ALL SELECT 'src', sa.cell_id, round(any_value(sa.area), 9), round(coalesce(sum(o.area), 0), 9), round(coalesce(sum(o.area), 0) / any_value(sa.area), 9) FROM sa LEFT JOIN o ON o.src = sa.cell_id WHERE sa.cell_id IN (SELECT cell_id FROM field) GROUP BY 2""",
    "covered_cells": _GRIDS + "SELECT DISTINCT dst AS cell_id FROM w SEMI JOIN field ON field.cell_id = w.src",
    "conserved_integrals": _GRIDS + "SELECT 'dst' AS side, round(sum(t.value * da.area), 6) AS integral FROM there t JOIN da USING (cell_id) UNION ALL SELECT 'src', round(sum(f.value * sa.area), 6) FROM field f JOIN sa USING (cell_id)",
    "esmf_weight_table": _GRIDS + "SELECT w.dst AS row, w.src AS col, w.area / da.area AS S, coalesce(f.value, 0)::BIGINT AS value FROM w JOIN da ON da.cell_id = w.dst LEFT JOIN field f ON f.cell_id = w.src",
    "regrid_errors": _GRIDS + ", e AS (SELECT abs(b.value - f.value) / abs(f.value) AS e FROM back b JOIN field f USING (cell_id)) SELECT round(max(e), 6) AS max_misfit, round(avg(e), 6) AS mean_misfit, round(sqrt(avg(e * e)), 6) AS rms_misfit FROM e",
    "overlapping_parts": _BOXES + "SELECT d.id AS dst_id, s.id AS src_id FROM d JOIN s ON d.x0 <= s.x1 AND s.x0 <= d.x1 AND d.y0 <= s.y1 AND s.y0 <= d.y1",
    "part_overlap_areas": _BOXES + "SELECT d.id AS dst, s.id AS src, round((least(d.x1, s.x1) - greatest(d.x0, s.x0)) * (least(d.y1, s.y1) - greatest(d.y0, s.y0)), 6) AS area FROM d JOIN s ON d.x0 < s.x1 AND s.x0 < d.x1 AND d.y0 < s.y1 AND s.y0 < d.y1",
    "example_fields": _POINTS + f""", g AS (SELECT *, {_SINUSOID} AS sinusoid, radians(lon + 80) AS dx, radians(lat - 25) AS dy, sqrt(pow(radians(78.2::DOUBLE), 2) + pow(radians(25::DOUBLE), 2)) AS far, sqrt(pow(radians(54.5::DOUBLE), 2) + pow(radians(30.5::DOUBLE), 2)) AS near,
  sin(0.2::DOUBLE) * cos(radians(lat)) * cos(radians(lon) - 5.5::DOUBLE) - cos(0.2::DOUBLE) * sin(radians(lat)) AS vx, cos(radians(lat)) * sin(radians(lon) - 5.5::DOUBLE) AS vy, sin(0.2::DOUBLE) * sin(radians(lat)) + cos(0.2::DOUBLE) * cos(radians(lat)) * cos(radians(lon) - 5.5::DOUBLE) AS vz FROM p),
h AS (SELECT *, sqrt(dx * dx + dy * dy) AS r, atan2(dy, dx) AS th, 3 * cos(asin(greatest(least(vz, 1), -1))) AS rho, CASE WHEN atan2(vy, vx) < 0 THEN atan2(vy, vx) + 2 * pi() ELSE atan2(vy, vx) END AS ang FROM g)
SELECT id, round(lon, 6) AS longitude, round(sinusoid, 6) AS sinusoid, round(2 + pow(sin(2 * radians(lat)), 16) * cos(16 * radians(lon)), 6) AS harmonic,
  round(sinusoid + (greatest(1000 * sin(0.4::DOUBLE * (0.5::DOUBLE * r + th) + 0.007::DOUBLE * cos(50 * th) + 0.37::DOUBLE * pi()), 999) - 999) * CASE WHEN r > far THEN 0 WHEN r > near THEN 1.3::DOUBLE * cos(pi() * 0.5::DOUBLE * (r - near) / (far - near)) ELSE 1.3::DOUBLE END, 6) AS gulf_stream,
  round(2 * (1 + tanh(rho / 5 * sin(ang - 6 * CASE WHEN rho = 0 THEN 0 ELSE 3 * sqrt(3) / 2 / pow(cosh(rho), 2) * tanh(rho) / rho END))), 6) AS vortex FROM h""",
    "customer_triangles": _POINTS + f"SELECT id, round(abs({_excess('a', 'b', 'c')}), 9) AS area FROM (SELECT id, {_unit('lon', 'lat')} AS a, {_unit('lon + 10', 'lat')} AS b, {_unit('lon', 'least(lat + 10, 90)')} AS c FROM p)",
    "part_polygon_areas": "WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y FROM part) SELECT p_partkey, round(abs((x * y - (x + 2) * 1) + ((x + 2) * (y / 2) - (-1) * y)) / 2, 6) AS area FROM p",
    "latlon_areas": _POINTS + _BY_CELL + ", a AS (" + _quad_areas(_TENS) + ") SELECT a.cell_id, area, value FROM a JOIN f ON f.cell_id = a.cell_id",
    "healpix_numbers": """
WITH p AS (SELECT c_custkey, i AS nested, i // 64 AS face, i % 64 AS k FROM (SELECT c_custkey, (c_custkey * 37) % 768 AS i FROM customer)),
xy AS (SELECT c_custkey, nested, face, (k & 1) | ((k >> 1) & 2) | ((k >> 2) & 4) AS ix, ((k >> 1) & 1) | ((k >> 2) & 2) | ((k >> 3) & 4) AS iy FROM p),
r AS (SELECT *, [2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4][face + 1] * 8 - ix - iy - 1 AS jr, [1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7][face + 1] AS jp FROM xy),
n AS (SELECT *, CASE WHEN jr < 8 THEN jr WHEN jr > 24 THEN 32 - jr ELSE 8 END AS nr, CASE WHEN jr < 8 OR jr > 24 THEN 0 ELSE (jr - 8) & 1 END AS shift FROM r),
b AS (SELECT *, CASE WHEN jr < 8 THEN 2 * nr * (nr - 1) WHEN jr > 24 THEN 768 - 2 * nr * (nr + 1) ELSE 112 + (jr - 8) * 32 END AS before, (jp * nr + ix - iy + 1 + shift) // 2 AS q FROM n)
SELECT c_custkey, nested::BIGINT AS nested, face::BIGINT AS face, ix::BIGINT AS ix, iy::BIGINT AS iy, (before + ((q - 1 + 4 * nr) % (4 * nr)))::BIGINT AS ring FROM b""",
    "ring_grid_cells": _POINTS + ", n AS (SELECT floor(((lon + 382.5::DOUBLE) % 360) / 45)::BIGINT AS i, least(floor((lat + 90) / 45), 3)::BIGINT AS j, count(*) AS n FROM p GROUP BY 1, 2) SELECT ((3 - j) * 8 + i + 1)::BIGINT AS cell_id, (i + 1)::INTEGER AS i, (j + 1)::INTEGER AS j, round((sin(radians(j * 45::DOUBLE - 90)) + sin(radians(j * 45::DOUBLE - 45))) / 2, 9) AS z, n FROM n",
    "offset_union": "WITH k AS (SELECT count(*) AS k FROM part) SELECT p_partkey::BIGINT + 1 AS cell_id, 1.25::DOUBLE AS area, 1::INTEGER AS part, p_partkey::BIGINT + 1 AS local FROM part UNION ALL SELECT k + 1, 3, 2, 1 FROM k UNION ALL SELECT k + 2 + p_partkey, 1.875, 3, p_partkey + 1 FROM part, k",
    "folded_row": "WITH f AS (SELECT (o_custkey % 56 + 1)::BIGINT AS cell_id, count(*)::DOUBLE AS value FROM orders GROUP BY 1), g AS (SELECT *, cell_id - 48 AS r FROM f) SELECT g.cell_id, coalesce(t.value, g.value) AS value FROM g LEFT JOIN g t ON t.r = 9 - g.r AND (t.r BETWEEN 1 AND 2 OR t.r BETWEEN 5 AND 6) AND g.r BETWEEN 1 AND 8",
    "shared_nodes": "SELECT s_suppkey AS node_id, round(sum(floor(s_acctbal)::DOUBLE * (s_suppkey % 4 + 1)) OVER n / sum(s_suppkey % 4 + 1) OVER n, 6) AS value FROM supplier WINDOW n AS (PARTITION BY s_nationkey)",
    "regrid_spheres": _POINTS + ", f AS (SELECT (floor(((lon + 360) % 360) / 10) + 1 + least(floor((lat + 90) / 10), 17) * 36)::BIGINT AS cell_id, count(*)::DOUBLE AS value FROM p GROUP BY 1), a AS (" + _quad_areas("SELECT (i + 1 + j * 36)::BIGINT AS cell_id, i * 10::DOUBLE AS a0, (i + 1) * 10::DOUBLE AS a1, j * 10::DOUBLE - 90 AS b0, (j + 1) * 10::DOUBLE - 90 AS b1 FROM range(36) x(i), range(18) y(j)").replace("round(abs(", "abs((").replace("), 9) AS", ")) AS") + "), t AS (SELECT round(sum(f.value * a.area), 6) AS integral FROM f JOIN a USING (cell_id)) SELECT grid, integral FROM t, (VALUES ('healpix'), ('cubed'), ('rotated'), ('rings')) g(grid)",
    "dispatched_grid": _POINTS + ", n AS (SELECT (floor(lon / 90) + 1 + floor(lat / 45) * 2)::BIGINT AS cell_id, count(*) AS n FROM p WHERE lon BETWEEN 0 AND 179 AND lat >= 0 GROUP BY 1), a AS (SELECT 'planar' AS kind, (i + 1 + j * 2)::BIGINT AS cell_id, 4050::DOUBLE AS area FROM range(2) x(i), range(2) y(j) UNION ALL SELECT 'spherical', * FROM (" + _quad_areas("SELECT (i + 1 + j * 2)::BIGINT AS cell_id, i * 90::DOUBLE AS a0, (i + 1) * 90::DOUBLE AS a1, j * 45::DOUBLE AS b0, (j + 1) * 45::DOUBLE AS b1 FROM range(2) x(i), range(2) y(j)") + ")) SELECT a.*, n FROM a JOIN n USING (cell_id)",
    "regrid_large_lattice": "WITH o AS (SELECT (o_orderkey::BIGINT * 7919) % 480000 AS k FROM orders), s AS (SELECT (k % 800) // 2 + 1 + (k // 1600) * 400 AS cell_id, count(*) AS n FROM o GROUP BY 1) SELECT c.i::BIGINT AS cell_id, coalesce(n, 0)::DOUBLE / 4 AS value FROM range(1, 120001) c(i) LEFT JOIN s ON s.cell_id = c.i",
}
