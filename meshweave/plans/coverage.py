"""More registered queries: grids, spheres, spectral elements and fields whose results have a closed form in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.points import planar_point, unit_point
from ..functions.shared import written
from ..manifold import sphere
from ..operators.fields import Field, cell_means, interior, sample
from ..operators.metrics import error_metrics
from ..operators.pixels import points_in_regions, polygon_poles
from ..operators.regridder import Regridder, build_regridder
from ..operators.spectral import SpectralSpace, cells_to_nodes, nodes_to_cells
from ..sources import as_grid, corner_grid, cubed_sphere, fold_grid, healpix_grid, latlon_grid, polygon_grid, regular_grid, rotated_latlon_grid
from . import queries as base

#: An L of two boxes, and a square with a square hole: exterior and holes.
SHAPES = (
    ([(0.5, 0.25), (3.5, 0.25), (3.5, 1.5), (1.5, 1.5), (1.5, 3.75), (0.5, 3.75)], []),
    ([(0.25, 0.5), (3.75, 0.5), (3.75, 3.5), (0.25, 3.5)], [[(1.5, 1.25), (2.75, 1.25), (2.75, 2.5), (1.5, 2.5)]]),
)


def supplier_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, ring, holes: a shape for each supplier, placed by its key."""
    k = F.col("s_suppkey")
    x, y = F.pmod(k * 7, F.lit(97)) / 8, F.pmod(k * 11, F.lit(89)) / 8
    ring = lambda points: F.array(*[planar_point(x + a, y + b) for a, b in points])
    (one, _), (other, holes) = SHAPES
    none = F.array().cast("array<array<struct<x: double, y: double>>>")
    odd = F.pmod(k, F.lit(2)) == 1
    return base.table(spark, sf_dir, "supplier").select(k.cast("bigint").alias("cell_id"), F.when(odd, ring(one)).otherwise(ring(other)).alias("ring"), F.when(odd, none).otherwise(F.array(*map(ring, holes))).alias("holes"))


def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of orders of each priority: a constant for each."""
    return base.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("value"))


def corner_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrilaterals between points of a lattice, each moved by the number of items of its quantity and line."""
    n = F.count(F.lit(1))
    i, j = F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int")
    corners = base.table(spark, sf_dir, "lineitem").groupBy(i.alias("i"), j.alias("j")).agg(n.alias("n"))
    corners = corners.select("i", "j", planar_point(F.col("i") + F.pmod("n", F.lit(16)) / 64, F.col("j") * 2 + F.pmod("n", F.lit(5)) / 16).alias("point"))
    return corner_grid(spark, corners, (49, 6)).areas().select("cell_id", F.round("area", 9).alias("area"))


def permuted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source grid and its field in another order of cells."""
    src = regular_grid(spark, base.FINE_X, base.FINE_Y)
    turned = F.lit(src.n_cells + 1) - F.col("cell_id")
    grid = src.with_ids(src.cells.select("cell_id", turned.alias("new_id")))
    field = base.lineitem_field(spark, sf_dir).withColumn("cell_id", turned)
    return build_regridder(regular_grid(spark, base.COARSE_X, base.COARSE_Y), grid).regrid(field)


def folded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by flag on a lattice whose last row is folded: ghosts get the values of their twins, for every flag."""
    dst = fold_grid(regular_grid(spark, [k * 6.5 for k in range(9)], [k * 3.0 - 1 for k in range(5)]))
    r = build_regridder(dst, regular_grid(spark, base.FINE_X, base.FINE_Y))
    field = Field(regular_grid(spark, base.FINE_X, base.FINE_Y), base.lineitem_field(spark, sf_dir, "l_returnflag"))
    return field.regrid(r, dst, by=["l_returnflag"]).data.select("cell_id", "l_returnflag", F.round("value", 6).alias("value"))


def shapes_on_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of the suppliers' shapes, with a notch or a hole, and the cells of a lattice."""
    r = build_regridder(regular_grid(spark, range(17), range(17)), polygon_grid(spark, supplier_shapes(spark, sf_dir)))
    return r.weights.where("area > 1e-9").select("dst", "src", F.round("area", 9).alias("area"))


def squared_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom operator in place of the overlap area, on cells with items."""

    def squared(src: list[tuple], dst: list[tuple]) -> float:
        sides = [min(max(p[k] for p in src), max(p[k] for p in dst)) - max(min(p[k] for p in src), min(p[k] for p in dst)) for k in (0, 1)]
        return max(sides[0], 0.0) ** 2 * max(sides[1], 0.0) ** 2

    r = build_regridder(regular_grid(spark, base.COARSE_X, base.COARSE_Y), regular_grid(spark, base.FINE_X, base.FINE_Y), operator=squared)
    field = base.lineitem_field(spark, sf_dir).withColumnRenamed("cell_id", "src")
    return r.weights.join(field, "src").select("dst", "src", F.round("area", 9).alias("area"), "value")


def items_by_given_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regridder of tables, in which parts of a weight are summed."""
    r = base.lineitem_regridder(spark)
    parts = r.weights.withColumn("area", F.explode(F.array(F.col("area") / 4, F.col("area") * 3 / 4)))
    return Regridder.from_weights(parts, r.dst_areas, r.src_areas, r.manifold).regrid(base.lineitem_field(spark, sf_dir))


def regrid_small_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item counts as a numpy array, lines by quantities, with the cells along its second axis."""
    k, c = (F.col("l_linenumber") - 1).cast("int"), (F.col("l_quantity") - 1).cast("int")
    counts = base.table(spark, sf_dir, "lineitem").groupBy(k.alias("k"), c.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    array = np.zeros((7, 50))
    for row in counts.collect():  # 7 x 50 at most
        array[row.k, row.c] = row.n
    r = build_regridder(regular_grid(spark, [0, 2, 3, 7, 10], [0, 2, 5]), regular_grid(spark, range(11), range(6)))
    out = r.regrid_array(array, dims=2)
    return spark.createDataFrame([(k, c + 1, float(out[k, c])) for k in range(7) for c in range(8)], "k bigint, cell_id bigint, value double").select("k", "cell_id", F.round("value", 6).alias("value"))


def halo_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's array with two cells of halo around it: only the cells inside are regridded."""
    row = base.table(spark, sf_dir, "lineitem").select((F.floor("l_quantity") + 1).cast("int").alias("i"), (F.floor(F.round(F.col("l_discount") * 100)) + 1).cast("int").alias("j"))
    field = interior(row.groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("value")), (44, 6), 2)
    return build_regridder(regular_grid(spark, [0, 22, 44], [0, 3, 6]), regular_grid(spark, range(45), range(7))).regrid(field)


def misfit_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the extremes of a field go beyond those of the field it came from."""
    r, field = base.lineitem_regridder(spark), base.lineitem_field(spark, sf_dir)
    return error_metrics(r.transpose().regrid(r.regrid(field)), field).select(F.round("l_min", 6).alias("l_min"), F.round("l_max", 6).alias("l_max"))


def sampled_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field at the centers of the parts' boxes."""
    grid = polygon_grid(spark, base.part_boxes(spark, sf_dir, 0.5, 2.5))
    return sample(grid, lambda x, y: 10 * x + y * y / 1024).data.select("cell_id", F.round("value", 6).alias("value"))


def looked_up_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by id and by index, with their areas, from a table that is taken as a grid."""
    table = base.part_boxes(spark, sf_dir, 0.5, 2.5)
    lattice = regular_grid(spark, [0, 1, 2, 4, 8], [0, 2, 3])
    found = lattice.cell(7).unionByName(lattice.cell(4, 1)).select(F.lit("lattice").alias("grid"), "cell_id", "ring")
    found = found.unionByName(as_grid(table).cell(3).select(F.lit("parts").alias("grid"), "cell_id", "ring"))
    return found.select("grid", "cell_id", F.get("ring", F.lit(0))["x"].alias("x"), F.get("ring", F.lit(2))["y"].alias("y"))


def hemisphere_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spherical overlaps cell by cell: slices of hemispheres that have customers, whose edges are meridians and the equator."""
    r = build_regridder(latlon_grid(spark, 8, 2), latlon_grid(spark, 36, 2))
    found = r.weights.where("area > 1e-9").join(customers_by_slice(spark, sf_dir).withColumnRenamed("cell_id", "src"), "src")
    return found.select("dst", "src", F.round("area", 7).alias("area"), "value")


def customers_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in 36 slices of each hemisphere."""
    lon, lat = F.pmod(F.col("lon"), F.lit(360.0)), F.col("lat")
    cell = (F.floor(lon / 10) + 1 + F.when(lat >= 0, 36).otherwise(0)).cast("bigint")
    return base.customer_points(spark, sf_dir).groupBy(cell.alias("cell_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def regrid_hemispheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer counts on slices of hemispheres, and on coarser slices that do not fit them."""
    field = customers_by_slice(spark, sf_dir)
    out = build_regridder(latlon_grid(spark, 8, 2, radius=2.0), latlon_grid(spark, 36, 2, radius=2.0), manifold=sphere(2.0)).regrid(field)
    return out.select("cell_id", F.round("value", 6).alias("value"))


def cube_on_meridians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of a cube's equatorial faces, quartered, and octants of the sphere; customers are dealt to the quarters."""
    r = build_regridder(latlon_grid(spark, 4, 2), cubed_sphere(spark, 2))
    cell = (F.pmod("c_custkey", F.lit(24)) + 1).cast("bigint")
    dealt = base.table(spark, sf_dir, "customer").groupBy(cell.alias("src")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    found = r.weights.where("src <= 16 AND area > 1e-9").join(dealt, "src")
    return found.groupBy("src").agg(F.round(F.sum("area"), 7).alias("area"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("area") * F.col("value")), 6).alias("value"))


def healpix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants on HEALPix pixels, one for each priority, stay constant on every cell of another grid."""
    r = build_regridder(latlon_grid(spark, 9, 6), healpix_grid(spark, 2))
    field = r.src_areas.select("cell_id").join(F.broadcast(priorities(spark, sf_dir)))  # five rows
    return r.regrid(field, by="o_orderpriority").select("cell_id", "o_orderpriority", F.round("value", 5).alias("value"))


def cubed_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the quarters of a cube's faces, found by HEALPix keys; the quarters are equal by symmetry."""
    grid = cubed_sphere(spark, 2)
    grid = replace(grid, cells=written(grid.cells))  # the corners are long expressions that poles would repeat
    cells = grid.cells.select(F.col("cell_id").alias("region_id"), polygon_poles(F.col("ring")).alias("poles"))
    points = base.customer_points(spark, sf_dir).select(F.col("id").alias("point_id"), unit_point(F.col("lon") + 0.37, F.col("lat") * 0.98 + 0.21).alias("point"))
    counts = points_in_regions(points, cells, depth=4).groupBy(F.col("region_id").alias("cell_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("point_id").alias("ids"))
    return grid.areas().join(counts, "cell_id").select("cell_id", F.round("area", 9).alias("area"), "n", "ids")


def rotated_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turning a grid changes no area; customers by cell, as in latlon_areas."""
    found = rotated_latlon_grid(spark, 36, 18, (40.0, 60.0)).areas().join(base.customers_by_cell(spark, sf_dir), "cell_id")
    return found.select("cell_id", F.round("area", 9).alias("area"), "value")


def means_of_a_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by quadrature over the cells that have customers, with their number."""
    found = cell_means(latlon_grid(spark, 36, 18), lambda lon, lat: np.full_like(lon, 2.5)).data.withColumnRenamed("value", "mean")
    return found.join(base.customers_by_cell(spark, sf_dir), "cell_id").select("cell_id", F.round("mean", 9).alias("mean"), "value")


def spectral_to_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant for each priority at the nodes of spectral elements is that constant on every cell."""
    space = SpectralSpace(spark, 2, 3)
    nodes = spark.range(1, space.n_nodes + 1).withColumnRenamed("id", "cell_id").join(F.broadcast(priorities(spark, sf_dir)))  # five rows
    r = nodes_to_cells(space, latlon_grid(spark, 8, 4))
    return r.regrid(nodes, by="o_orderpriority").select("cell_id", "o_orderpriority", F.round("value", 3).alias("value"))


def cells_to_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """And back: constants on cells are those constants at every node."""
    r = cells_to_nodes(SpectralSpace(spark, 2, 3), latlon_grid(spark, 8, 4))
    field = r.src_areas.select("cell_id").join(F.broadcast(priorities(spark, sf_dir)))  # five rows
    return r.regrid(field, by="o_orderpriority").select("cell_id", "o_orderpriority", F.round("value", 3).alias("value"))


def nodes_by_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of neighbouring elements at one place: inside, on an edge, where three or four elements meet."""
    nodes = SpectralSpace(spark, 3, 4).shared_nodes()
    own = nodes.groupBy("global_node").agg(F.count(F.lit(1)).alias("copies"))
    node = (F.pmod("c_custkey", F.lit(54 * 16)) + 1).cast("bigint")
    dealt = base.table(spark, sf_dir, "customer").groupBy(node.alias("node_id")).agg(F.count(F.lit(1)).alias("customers"))
    placed = nodes.join(dealt, "node_id").groupBy("global_node").agg(F.sum("customers").alias("customers"))
    return own.join(placed, "global_node", "left").groupBy("copies").agg(F.count(F.lit(1)).alias("places"), F.coalesce(F.sum("customers"), F.lit(0)).alias("customers"))


def node_weights_by_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrature weights of a cube's faces add up to a sixth of the sphere."""
    nodes = SpectralSpace(spark, 3, 4, 2.0).nodes()
    node = (F.pmod("c_custkey", F.lit(54 * 16)) + 1).cast("bigint")
    dealt = base.table(spark, sf_dir, "customer").groupBy(node.alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    face = (F.floor((F.col("elem_id") - 1) / 9) + 1).alias("face")
    return nodes.join(dealt, "node_id", "left").groupBy(face).agg(F.round(F.sum("wj"), 3).alias("area"), F.coalesce(F.sum("n"), F.lit(0)).alias("customers"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (corner_areas, permuted_items, folded_items, shapes_on_lattice, squared_overlaps, items_by_given_weights, regrid_small_array, halo_items, misfit_extremes, sampled_centers, looked_up_cells, hemisphere_weights, regrid_hemispheres, cube_on_meridians, healpix_totals, cubed_areas, rotated_areas, means_of_a_constant, spectral_to_cells, cells_to_spectral, nodes_by_copies, node_weights_by_face)}

_SLICES = """
WITH s AS (SELECT (i + 1 + j * 36)::BIGINT AS id, j, i * 10::DOUBLE AS a0, (i + 1) * 10::DOUBLE AS a1 FROM range(36) x(i), range(2) y(j)),
d AS (SELECT (i + 1 + j * 8)::BIGINT AS id, j, i * 45::DOUBLE AS a0, (i + 1) * 45::DOUBLE AS a1 FROM range(8) x(i), range(2) y(j)),
w AS (SELECT d.id AS dst, s.id AS src, radians(least(d.a1, s.a1) - greatest(d.a0, s.a0)) AS area FROM d JOIN s ON d.j = s.j AND d.a0 < s.a1 AND s.a0 < d.a1)
"""

ORACLE_SQL: dict[str, str] = {
    "corner_areas": """
WITH c AS (SELECT l_quantity::INTEGER AS i, l_linenumber::INTEGER AS j, count(*) AS n FROM lineitem GROUP BY 1, 2),
p AS (SELECT i, j, i + (n % 16) / 64::DOUBLE AS x, j * 2 + (n % 5) / 16::DOUBLE AS y FROM c)
SELECT (a.i + (a.j - 1) * 49)::BIGINT AS cell_id, round(abs((c.x - a.x) * (d.y - b.y) - (d.x - b.x) * (c.y - a.y)) / 2, 9) AS area
FROM p a JOIN p b ON b.i = a.i + 1 AND b.j = a.j JOIN p c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN p d ON d.i = a.i AND d.j = a.j + 1""",
    "permuted_items": base._GRIDS + "SELECT cell_id, value FROM there",
    "folded_items": base._GRIDS + """, fold AS (SELECT (i + 1 + j * 8)::BIGINT AS id, i + 1 AS i, j, i * 6.5::DOUBLE AS x0, (i + 1) * 6.5::DOUBLE AS x1, j * 3::DOUBLE - 1 AS y0, (j + 1) * 3::DOUBLE - 1 AS y1 FROM range(8) a(i), range(4) b(j)),
counts AS (SELECT cell_id, l_returnflag, count(*)::DOUBLE AS value FROM items GROUP BY 1, 2),
flags AS (SELECT DISTINCT l_returnflag FROM lineitem),
parts AS (SELECT d.id, c.l_returnflag, sum((least(d.x1, f.x1) - greatest(d.x0, f.x0)) * (least(d.y1, f.y1) - greatest(d.y0, f.y0)) * c.value) AS value
  FROM fold d JOIN fine f ON d.x0 < f.x1 AND f.x0 < d.x1 AND d.y0 < f.y1 AND f.y0 < d.y1 JOIN counts c ON c.cell_id = f.id GROUP BY 1, 2),
own AS (SELECT d.id, d.i, d.j, g.l_returnflag, coalesce(p.value, 0) / 19.5::DOUBLE AS value FROM fold d CROSS JOIN flags g LEFT JOIN parts p ON p.id = d.id AND p.l_returnflag = g.l_returnflag)
SELECT o.id AS cell_id, o.l_returnflag, round(CASE WHEN o.j = 3 AND o.i IN (3, 4, 7, 8) THEN t.value ELSE o.value END, 6) AS value
FROM own o LEFT JOIN own t ON t.j = 3 AND t.i = 9 - o.i AND t.l_returnflag = o.l_returnflag""",
    "shapes_on_lattice": """
WITH t AS (SELECT * FROM (VALUES (1, 1, 0.5, 0.25, 1.5, 3.75), (1, 1, 1.5, 0.25, 3.5, 1.5), (0, 1, 0.25, 0.5, 3.75, 3.5), (0, -1, 1.5, 1.25, 2.75, 2.5)) t(odd, sign, x0, y0, x1, y1)),
b AS (SELECT s_suppkey::BIGINT AS src, sign, (s_suppkey * 7) % 97 / 8::DOUBLE + x0::DOUBLE AS x0, (s_suppkey * 7) % 97 / 8::DOUBLE + x1::DOUBLE AS x1, (s_suppkey * 11) % 89 / 8::DOUBLE + y0::DOUBLE AS y0, (s_suppkey * 11) % 89 / 8::DOUBLE + y1::DOUBLE AS y1 FROM supplier JOIN t ON t.odd = s_suppkey % 2),
c AS (SELECT (i + 1 + j * 16)::BIGINT AS dst, i AS a, j AS b FROM range(16) x(i), range(16) y(j)),
o AS (SELECT dst, src, sum(sign * (least(x1, a + 1) - greatest(x0, a)) * (least(y1, c.b + 1) - greatest(y0, c.b))) AS area FROM b JOIN c ON x0 < a + 1 AND a < x1 AND y0 < c.b + 1 AND c.b < y1 GROUP BY 1, 2)
SELECT dst, src, round(area, 9) AS area FROM o WHERE area > 1e-9""",
    "squared_overlaps": base._GRIDS + "SELECT dst, src, round(area * area, 9) AS area, count(*) AS value FROM w JOIN items ON items.cell_id = w.src GROUP BY dst, src, area",
    "items_by_given_weights": base._GRIDS + "SELECT cell_id, value FROM there",
    "regrid_small_array": """
WITH c AS (SELECT l_linenumber::BIGINT - 1 AS k, (l_quantity::INTEGER - 1) % 10 AS i, (l_quantity::INTEGER - 1) // 10 AS j, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2, 3),
d AS (SELECT (a.i + b.j * 4 + 1)::BIGINT AS cell_id, x0, x1, y0, y1 FROM (VALUES (0, 0, 2), (1, 2, 3), (2, 3, 7), (3, 7, 10)) a(i, x0, x1), (VALUES (0, 0, 2), (1, 2, 5)) b(j, y0, y1))
SELECT l.k::BIGINT AS k, d.cell_id, round(coalesce(sum(n), 0) / any_value((x1 - x0) * (y1 - y0)), 6) AS value FROM d CROSS JOIN range(7) l(k) LEFT JOIN c ON c.k = l.k AND c.i >= x0 AND c.i < x1 AND c.j >= y0 AND c.j < y1 GROUP BY 1, 2""",
    "halo_items": "WITH c AS (SELECT (floor(l_quantity) + 1)::BIGINT - 2 AS i, (floor(round(l_discount * 100)) + 1)::BIGINT - 2 AS j FROM lineitem), k AS (SELECT (i - 1) // 22 AS a, (j - 1) // 3 AS b, count(*) AS n FROM c WHERE i BETWEEN 1 AND 44 AND j BETWEEN 1 AND 6 GROUP BY 1, 2) SELECT (x.a + 1 + y.b * 2)::BIGINT AS cell_id, coalesce(n, 0)::DOUBLE / 66 AS value FROM range(2) x(a) CROSS JOIN range(2) y(b) LEFT JOIN k ON k.a = x.a AND k.b = y.b",
    "misfit_extremes": base._GRIDS + "SELECT round((min(f.value) - min(b.value)) / max(abs(f.value)), 6) AS l_min, round((max(b.value) - max(f.value)) / max(abs(f.value)), 6) AS l_max FROM back b JOIN field f USING (cell_id)",
    "sampled_centers": "SELECT p_partkey::BIGINT AS cell_id, round(10 * (p_size::DOUBLE + 0.25::DOUBLE) + pow(floor(p_retailprice::DOUBLE) + 1.25::DOUBLE, 2) / 1024, 6) AS value FROM part",
    "looked_up_cells": "SELECT 'lattice' AS grid, 7::BIGINT AS cell_id, 2::DOUBLE AS x, 3::DOUBLE AS y UNION ALL SELECT 'lattice', 4, 4, 2 UNION ALL SELECT 'parts', p_partkey, p_size::DOUBLE, floor(p_retailprice::DOUBLE) + 2.5::DOUBLE FROM part WHERE p_partkey = 3",
    "hemisphere_weights": base._POINTS + ", " + _SLICES.replace("\nWITH ", "", 1) + ", f AS (SELECT (floor(((lon + 360) % 360) / 10) + 1 + CASE WHEN lat >= 0 THEN 36 ELSE 0 END)::BIGINT AS id, count(*)::DOUBLE AS value FROM p GROUP BY 1) SELECT dst, src, round(area, 7) AS area, value FROM w JOIN f ON f.id = w.src",
    "regrid_hemispheres": base._POINTS + ", " + _SLICES.replace("\nWITH ", "", 1) + ", f AS (SELECT (floor(((lon + 360) % 360) / 10) + 1 + CASE WHEN lat >= 0 THEN 36 ELSE 0 END)::BIGINT AS id, count(*)::DOUBLE AS value FROM p GROUP BY 1) SELECT d.id AS cell_id, round(coalesce(sum(w.area * f.value), 0) / radians(45::DOUBLE), 6) AS value FROM d LEFT JOIN w ON w.dst = d.id LEFT JOIN f ON f.id = w.src GROUP BY 1",
    "cube_on_meridians": "SELECT (c_custkey % 24 + 1)::BIGINT AS src, round(pi() / 6, 7) AS area, 1::BIGINT AS n, round(count(*) * pi() / 6, 6) AS value FROM customer WHERE c_custkey % 24 < 16 GROUP BY 1",
    "healpix_totals": "SELECT i::BIGINT AS cell_id, o_orderpriority, count(*)::DOUBLE AS value FROM orders, range(1, 55) t(i) GROUP BY 1, 2",
    "cubed_areas": base._POINTS + f""", q AS (SELECT id, {base._unit('(lon + 0.37::DOUBLE)', '(lat * 0.98::DOUBLE + 0.21::DOUBLE)')} AS p FROM p),
f AS (SELECT id, p.x AS x, p.y AS y, p.z AS z, greatest(abs(p.x), abs(p.y), abs(p.z)) AS most FROM q),
g AS (SELECT id, CASE WHEN x = most THEN 0 WHEN y = most THEN 1 WHEN -x = most THEN 2 WHEN -y = most THEN 3 WHEN z = most THEN 4 ELSE 5 END AS face,
  CASE WHEN x = most THEN y WHEN y = most THEN -x WHEN -x = most THEN -y WHEN -y = most THEN x ELSE y END AS u, CASE WHEN z = most THEN -x WHEN -z = most THEN x ELSE z END AS v FROM f)
SELECT (face * 4 + CASE WHEN u > 0 THEN 1 ELSE 0 END + CASE WHEN v > 0 THEN 2 ELSE 0 END + 1)::BIGINT AS cell_id, round(pi() / 6, 9) AS area, count(*) AS n, sum(id)::BIGINT AS ids FROM g GROUP BY 1""",
    "rotated_areas": base.ORACLE_SQL["latlon_areas"],
    "means_of_a_constant": base._POINTS + base._BY_CELL + " SELECT cell_id, 2.5::DOUBLE AS mean, value FROM f",
    "spectral_to_cells": "SELECT i::BIGINT AS cell_id, o_orderpriority, count(*)::DOUBLE AS value FROM orders, range(1, 33) t(i) GROUP BY 1, 2",
    "cells_to_spectral": "SELECT i::BIGINT AS cell_id, o_orderpriority, count(*)::DOUBLE AS value FROM orders, range(1, 217) t(i) GROUP BY 1, 2",
    "nodes_by_copies": """
WITH n AS (SELECT (f * 144 + (j * 3 + i) * 16 + q * 4 + p + 1)::BIGINT AS node_id, (i * 3 + p) IN (0, 9) AS side, (j * 3 + q) IN (0, 9) AS top, p IN (0, 3) AS at_x, q IN (0, 3) AS at_y FROM range(6) a(f), range(3) b(i), range(3) c(j), range(4) d(p), range(4) e(q)),
k AS (SELECT node_id, CASE WHEN side AND top THEN 3 WHEN at_x AND at_y THEN 4 WHEN at_x OR at_y THEN 2 ELSE 1 END AS copies FROM n),
c AS (SELECT c_custkey % 864 + 1 AS node_id, count(*) AS customers FROM customer GROUP BY 1)
SELECT copies::BIGINT AS copies, (count(*) // copies)::BIGINT AS places, coalesce(sum(customers), 0)::BIGINT AS customers FROM k LEFT JOIN c USING (node_id) GROUP BY copies""",
    "node_weights_by_face": "SELECT (i + 1)::BIGINT AS face, round(8 * pi() / 3, 3) AS area, (SELECT count(*) FROM customer WHERE c_custkey % 864 // 144 = i) AS customers FROM range(6) t(i)",
}
