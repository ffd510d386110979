"""Registered queries over outlines, regions and weights that come from the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.curves import along_the_curve, hilbert_point
from ..functions.points import unit_point
from ..functions.shared import shared_folder
from ..manifold import sphere
from ..operators.chains import ListField, product, regrid_field
from ..operators.elements import located
from ..operators.extents import extents_by
from ..operators.fields import with_halo
from ..operators.merged import merged
from ..operators.metrics import regridder_differences
from ..operators.pixels import cap_poles, polygon_poles, sums_in_regions
from ..operators.regridder import build_regridder
from ..sources import polygon_grid
from ..sources.grid import Grid
from ..sources.grids import uniform_grid
from ..sources.netcdf import load_netcdf_weights, save_netcdf_weights
from . import queries as base

#: Lattice under the outlines: steps that fit none of their vertices.
LATTICE = ((0.0, 1.25), (0.25, 0.75))


def profile_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon for each nation: its customers side by side, 0.5 wide, as high as their balances, closed along the bottom."""
    rows = base.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("cell_id"), "c_custkey", (F.col("c_acctbal").cast("double") / 512 + 2).alias("y"))
    k = F.row_number().over(Window.partitionBy("cell_id").orderBy("c_custkey")) - 1
    points = rows.select("cell_id", F.struct((k * 0.5).alias("x"), "y").alias("p")).groupBy("cell_id").agg(F.array_sort(F.collect_list("p")).alias("top"))
    ends = [F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y")) for x in (F.element_at("top", -1)["x"], F.lit(0.0))]
    return points.where(F.size("top") > 1).select("cell_id", F.concat("top", F.array(*ends)).alias("ring"))


def profile_lattice(spark: SparkSession, sf_dir: str):
    """A lattice over all outlines; its size follows the customers of the largest nation."""
    most = base.table(spark, sf_dir, "customer").groupBy("c_nationkey").count().agg(F.max("count")).first()[0] or 1
    (x0, dx), (y0, dy) = LATTICE
    nx = int(most * 0.5 / dx) + 1
    return uniform_grid(spark, nx, 30, (x0, x0 + nx * dx), (y0, y0 + 30 * dy))


def outlines_on_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of outlines of hundreds of vertices in the cells of a lattice, by walking their edges."""
    r = build_regridder(profile_lattice(spark, sf_dir), polygon_grid(spark, profile_outlines(spark, sf_dir)))
    return r.weights.where("area > 1e-7").select("dst", "src", F.round("area", 6).alias("area"))


def outlines_on_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of the same outlines, which are not convex, and rectangles that form no lattice: outlines are cut once, before the join."""
    part = base.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("cell_id"), (F.col("p_size").cast("double") / 2).alias("x"), (F.floor(F.col("p_retailprice").cast("double")) / 128).alias("y"))
    ring = F.array(*[F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in ((0.0, 0.0), (0.375, 0.0), (0.375, 0.5), (0.0, 0.5))])
    r = build_regridder(merged(polygon_grid(spark, part.select("cell_id", ring.alias("ring")))), polygon_grid(spark, profile_outlines(spark, sf_dir)))
    return r.rounded(6, above=1e-7)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id and a point, off whole degrees, for each supplier."""
    k = F.col("s_suppkey")
    return base.table(spark, sf_dir, "supplier").select(k.cast("bigint").alias("region_id"), "s_nationkey", (F.pmod(k * 97, F.lit(360)) - 179.63).cast("double").alias("lon"), (F.pmod(k * 41, F.lit(160)) - 79.58).cast("double").alias("lat"))


def customers_near_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within caps around suppliers, found by the ancestors of their HEALPix pixels."""
    caps = suppliers(spark, sf_dir).select("region_id", cap_poles(unit_point(F.col("lon"), F.col("lat")), F.radians(F.col("s_nationkey") * 0.375 + 2.7)).alias("poles"))
    points = base.customer_points(spark, sf_dir).select(F.col("id").alias("point_id"), unit_point(F.col("lon"), F.col("lat")).alias("point"))
    return sums_in_regions(points, caps)


def customers_in_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for spherical triangles."""
    lon, lat = F.col("lon"), F.col("lat")
    ring = F.array(unit_point(lon, lat), unit_point(lon + 14.2, lat + 1.1), unit_point(lon + 3.3, lat + 9.1))
    triangles = suppliers(spark, sf_dir).select("region_id", polygon_poles(ring).alias("poles"))
    points = base.customer_points(spark, sf_dir).select(F.col("id").alias("point_id"), unit_point(lon, lat).alias("point"))
    return sums_in_regions(points, triangles, depth=5)


def orders_under_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few large boxes over a box for each order: the bins at the large ones' level are split where orders are dense."""

    def boxes(rows: DataFrame, x, y, width: float, height: float) -> DataFrame:
        return polygon_grid(spark, rows.select("cell_id", F.array(*[F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in ((0, 0), (width, 0), (width, height), (0, height))]).alias("ring")))

    orders = base.table(spark, sf_dir, "orders").withColumn("cell_id", F.col("o_orderkey").cast("bigint"))
    regions = base.table(spark, sf_dir, "region").withColumn("cell_id", F.col("r_regionkey").cast("bigint") + 1)
    dst = boxes(regions, F.col("r_regionkey") * 3000 + 0.25, F.lit(-0.5), 4000.5, 400.25)
    src = boxes(orders, F.pmod("o_custkey", F.lit(15000)), F.floor(F.col("o_totalprice").cast("double") / 1024), 0.75, 0.5)
    r = build_regridder(dst, src)
    return r.weights.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 6).alias("area"), F.sum("src").alias("ids"))


def items_through_netcdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item counts by weights that went through a NetCDF file, written and read by tasks."""
    path = save_netcdf_weights(f"{shared_folder(spark)}/items.nc", base.lineitem_regridder(spark), src_grid_name="items")
    out = load_netcdf_weights(spark, path).regrid(base.lineitem_field(spark, sf_dir))
    return out.select("cell_id", F.round("value", 6).alias("value"))


def nation_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps around small triangles at the customers of each nation."""
    points = base.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(base.customer_points(spark, sf_dir), F.col("c_custkey") == F.col("id"))
    lon, lat = F.col("c_nationkey") * 14 - 180 + F.pmod("lon", F.lit(40)), F.col("lat") / 3
    ring = F.array(unit_point(lon, lat), unit_point(lon + 0.5, lat), unit_point(lon, lat + 0.5))
    cells = points.select(F.col("id").cast("bigint").alias("cell_id"), "c_nationkey", ring.alias("ring"))
    found = extents_by(Grid(cells, (1,), sphere()), ["c_nationkey"])
    return found.select("c_nationkey", *[F.round(f"cap.center.{a}", 8).alias(a) for a in "xyz"], F.round("cap.radius", 8).alias("radius"))


def orders_along_a_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders counted on a 64 x 64 lattice, summed over sixteenths of its space-filling curve: squares of the lattice."""
    grid = uniform_grid(spark, 64, 64, (0.0, 64.0), (0.0, 64.0))
    cell = (F.pmod("o_custkey", F.lit(64)) + 1 + F.pmod(F.floor(F.col("o_totalprice").cast("double") / 64), F.lit(64)) * 64).cast("bigint")
    field = base.table(spark, sf_dir, "orders").groupBy(cell.alias("cell_id")).agg(F.count(F.lit(1)).alias("n"))
    order = along_the_curve(grid, 64)
    x, y = hilbert_point(F.col("new_id") - 1, 6)
    placed = field.join(order, "cell_id").select("n", F.floor((F.col("new_id") - 1) / 256).alias("part"), x.alias("x"), y.alias("y"))
    return placed.groupBy("part").agg(F.sum("n").alias("n"), F.min(F.floor(F.col("x") / 16)).alias("x"), F.max(F.floor(F.col("x") / 16)).alias("xmax"), F.min(F.floor(F.col("y") / 16)).alias("y"), F.max(F.floor(F.col("y") / 16)).alias("ymax"))


def compared_part_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where overlaps of parts' boxes differ once the boxes of one side are lower."""
    a, b, c = (merged(polygon_grid(spark, base.part_boxes(spark, sf_dir, w, h))) for w, h in ((0.5, 2.5), (1.25, 1.5), (1.25, 1.25)))
    return regridder_differences(build_regridder(a, b), build_regridder(a, c), relative=0.125, digits=6).select("dst", "src", "one", "other", "off")


def items_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item counts there and back by one regridder, the product of both."""
    there = base.lineitem_regridder(spark)
    return product(there.transpose(), there).regrid(base.lineitem_field(spark, sf_dir)).select("cell_id", F.round("value", 6).alias("value"))


def parts_in_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point in a quadrilateral for each part, and its reference coordinates there."""
    k, x, y = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")
    xi, eta = F.pmod(k * 7, F.lit(17)) / 8 - 1, F.pmod(k * 5, F.lit(13)) / 6 - 1
    corners = [(x, y), (x + 2, y + 0.5), (x + 2.5 + F.pmod(k, F.lit(3)) / 4, y + 3), (x - 0.25, y + 1.5)]
    shapes = [(1 + a * xi) * (1 + b * eta) / 4 for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    point = F.struct(*[sum((s * c[n] for s, c in zip(shapes, corners, strict=True)), F.lit(0.0)).alias("xy"[n]) for n in (0, 1)])
    ring = F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in corners])
    rows = base.table(spark, sf_dir, "part").select(k.cast("bigint").alias("cell_id"), ring.alias("ring"), point.alias("point"))
    found = located(rows.select(F.col("cell_id").alias("point_id"), F.col("cell_id").alias("elem_id"), "point"), polygon_grid(spark, rows.select("cell_id", "ring")))
    return found.select("point_id", (F.round("xi", 6) + 0.0).alias("xi"), (F.round("eta", 6) + 0.0).alias("eta"))


def haloed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders counted on 8 x 6 cells, written into an array with two cells of halo: periodic, and folded at its last row."""
    cell = (F.pmod("o_custkey", F.lit(48)) + 1).cast("bigint")
    field = base.table(spark, sf_dir, "orders").groupBy(cell.alias("cell_id")).agg(F.count(F.lit(1)).alias("n"))
    return with_halo(field, (8, 6), 2, y="fold")


def items_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by line number as one array of values a cell: a field of another kind, regridded as it is."""
    rows = base.lineitem_field(spark, sf_dir, "l_linenumber")
    lists = rows.groupBy("cell_id").pivot("l_linenumber", list(range(1, 8))).agg(F.first("value")).fillna(0)
    field = ListField(lists.select("cell_id", F.array(*[F.col(str(k)).cast("double") for k in range(1, 8)]).alias("values")))
    out = regrid_field(base.lineitem_regridder(spark), field).data
    return out.select("cell_id", F.posexplode("values").alias("level", "value")).select("cell_id", "level", F.round("value", 6).alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (outlines_on_lattice, outlines_on_parts, customers_near_suppliers, customers_in_triangles, orders_under_regions, items_through_netcdf, nation_caps, orders_along_a_curve, compared_part_weights, items_by_product, parts_in_elements, haloed_orders, items_by_level)}

_TOPS = """
WITH c AS (SELECT c_nationkey::BIGINT AS src, (row_number() OVER n - 1) * 0.5::DOUBLE AS x, c_acctbal::DOUBLE / 512 + 2 AS y FROM customer WINDOW n AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
s AS (SELECT * FROM (SELECT src, x AS xa, y AS ya, lead(x) OVER n AS xb, lead(y) OVER n AS yb FROM c WINDOW n AS (PARTITION BY src ORDER BY x)) WHERE xb IS NOT NULL)
"""


def _under(boxes: str) -> str:
    """Area of each box (dst, x0, x1, y0, y1) under the line of each segment: integrals of a line above two levels."""
    above = lambda level: f"CASE WHEN abs(hb - ha) < 1e-12 THEN (b - a) * greatest(ha - {level}, 0) ELSE (b - a) * (pow(greatest(hb - {level}, 0), 2) - pow(greatest(ha - {level}, 0), 2)) / (2 * (hb - ha)) END"
    return f"""
, boxes AS ({boxes}),
cut AS (SELECT src, dst, greatest(y0, 0) AS y0, y1, greatest(xa, x0) AS a, least(xb, x1) AS b, xa, ya, (yb - ya) / (xb - xa) AS slope FROM s JOIN boxes ON xa < x1 AND x0 < xb AND y1 > 0),
h AS (SELECT *, ya + (a - xa) * slope AS ha, ya + (b - xa) * slope AS hb FROM cut)
SELECT dst, src, round(sum({above('y0')} - ({above('y1')})), 6) AS area FROM h GROUP BY dst, src HAVING sum({above('y0')} - ({above('y1')})) > 1e-7"""


_SUPPLIERS = "s AS (SELECT s_suppkey::BIGINT AS region_id, s_nationkey, ((s_suppkey * 97) % 360 - 179.63::DOUBLE)::DOUBLE AS lon, ((s_suppkey * 41) % 160 - 79.58::DOUBLE)::DOUBLE AS lat FROM supplier)"
_DOT = "(a.x * b.x + a.y * b.y + a.z * b.z)"


def _side(a: str, b: str) -> str:
    """Whether q lies left of the great circle from a to b."""
    return f"q.x * ({a}.y * {b}.z - {a}.z * {b}.y) + q.y * ({a}.z * {b}.x - {a}.x * {b}.z) + q.z * ({a}.x * {b}.y - {a}.y * {b}.x) >= 0"


ORACLE_SQL: dict[str, str] = {
    "outlines_on_lattice": _TOPS + _under("SELECT (i + 1 + j * (SELECT floor(max(n) * 0.5 / 1.25)::BIGINT + 1 FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)))::BIGINT AS dst, i * 1.25::DOUBLE AS x0, (i + 1) * 1.25::DOUBLE AS x1, 0.25::DOUBLE + j * 0.75::DOUBLE AS y0, 0.25::DOUBLE + (j + 1) * 0.75::DOUBLE AS y1 FROM (SELECT unnest(range((SELECT floor(max(n) * 0.5 / 1.25)::BIGINT + 1 FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)))) AS i), range(30) t(j)"),
    "outlines_on_parts": _TOPS + _under("SELECT p_partkey::BIGINT AS dst, p_size::DOUBLE / 2 AS x0, p_size::DOUBLE / 2 + 0.375::DOUBLE AS x1, floor(p_retailprice::DOUBLE) / 128 AS y0, floor(p_retailprice::DOUBLE) / 128 + 0.5::DOUBLE AS y1 FROM part"),
    "orders_under_regions": """
WITH d AS (SELECT r_regionkey::BIGINT + 1 AS dst, r_regionkey * 3000 + 0.25::DOUBLE AS x0, r_regionkey * 3000 + 4000.75::DOUBLE AS x1, -0.5::DOUBLE AS y0, 399.75::DOUBLE AS y1 FROM region),
s AS (SELECT o_orderkey::BIGINT AS src, (o_custkey % 15000)::DOUBLE AS a0, (o_custkey % 15000) + 0.75::DOUBLE AS a1, floor(o_totalprice::DOUBLE / 1024) AS b0, floor(o_totalprice::DOUBLE / 1024) + 0.5::DOUBLE AS b1 FROM orders)
SELECT dst, count(*) AS n, round(sum((least(x1, a1) - greatest(x0, a0)) * (least(y1, b1) - greatest(y0, b0))), 6) AS area, sum(src)::BIGINT AS ids FROM d JOIN s ON x0 < a1 AND a0 < x1 AND y0 < b1 AND b0 < y1 GROUP BY dst""",
    "items_through_netcdf": base._GRIDS + "SELECT cell_id, round(value, 6) AS value FROM there",
    "nation_caps": base._POINTS + f""", t AS (SELECT c_nationkey, c_nationkey * 14 - 180 + ((lon + 360) % 40) AS lo, lat / 3 AS la FROM customer JOIN p ON c_custkey = id),
v AS (SELECT c_nationkey, {base._unit('lo', 'la')} AS a, {base._unit('(lo + 0.5::DOUBLE)', 'la')} AS b, {base._unit('lo', '(la + 0.5::DOUBLE)')} AS c FROM t),
q AS (SELECT c_nationkey, unnest([a, b, c]) AS p FROM v),
m AS (SELECT c_nationkey, avg(p.x) AS x, avg(p.y) AS y, avg(p.z) AS z FROM q GROUP BY 1),
u AS (SELECT c_nationkey, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM m),
far AS (SELECT c_nationkey, max(2 * asin(sqrt(pow(p.x - x, 2) + pow(p.y - y, 2) + pow(p.z - z, 2)) / 2)) AS far FROM q JOIN u USING (c_nationkey) GROUP BY 1)
SELECT c_nationkey, round(x, 8) AS x, round(y, 8) AS y, round(z, 8) AS z, round(far * 1.0001::DOUBLE, 8) AS radius FROM u JOIN far USING (c_nationkey)""",
    "orders_along_a_curve": """
WITH RECURSIVE o AS (SELECT (o_custkey % 64)::BIGINT AS x, floor(o_totalprice::DOUBLE / 64)::BIGINT % 64 AS y FROM orders),
f AS (SELECT x, y, count(*) AS n FROM o GROUP BY 1, 2),
h AS (SELECT x AS px, y AS py, x, y, 32::BIGINT AS s, 0::BIGINT AS d FROM f
  UNION ALL SELECT px, py,
    CASE WHEN y >= s THEN x % s WHEN x >= s THEN s - 1 - y % s ELSE y % s END, CASE WHEN y >= s THEN y % s WHEN x >= s THEN s - 1 - x % s ELSE x % s END,
    s // 2, 4 * d + CASE WHEN x < s AND y < s THEN 0 WHEN x < s THEN 1 WHEN y >= s THEN 2 ELSE 3 END FROM h WHERE s > 0)
SELECT d // 256 AS part, sum(n)::BIGINT AS n, min(px // 16) AS x, max(px // 16) AS xmax, min(py // 16) AS y, max(py // 16) AS ymax FROM h JOIN f ON f.x = px AND f.y = py WHERE s = 0 GROUP BY 1""",
    "compared_part_weights": base._BOXES + """, w AS (SELECT d.id AS dst, s.id AS src, least(d.x1, s.x1) - greatest(d.x0, s.x0) AS wide, least(d.y1, s.y1) - greatest(d.y0, s.y0) AS one, least(d.y1, s.y1 - 0.25::DOUBLE) - greatest(d.y0, s.y0) AS other FROM d JOIN s ON d.x0 < s.x1 AND s.x0 < d.x1 AND d.y0 < s.y1 AND s.y0 < d.y1),
both_ AS (SELECT dst, src, wide * one AS one, wide * greatest(other, 0) AS other, max(wide * one) OVER (PARTITION BY dst) AS most FROM w)
SELECT dst, src, round(one, 6) AS one, round(other, 6) AS other, round(one - other, 6) AS off FROM both_ WHERE one - other > 0.125::DOUBLE * most""",
    "items_by_product": base._GRIDS + "SELECT cell_id, round(value, 6) AS value FROM back",
    "parts_in_elements": "SELECT p_partkey::BIGINT AS point_id, round(((p_partkey * 7) % 17)::DOUBLE / 8 - 1, 6) AS xi, round(((p_partkey * 5) % 13)::DOUBLE / 6 - 1, 6) AS eta FROM part",
    "haloed_orders": """
WITH f AS (SELECT o_custkey % 48 AS c, count(*) AS n FROM orders GROUP BY 1),
a AS (SELECT i, j, i - 2 AS x, j - 2 AS y FROM range(1, 13) t(i), range(1, 11) u(j) WHERE j > 2),
b AS (SELECT i, j, CASE WHEN y > 6 THEN 9 - ((x + 7) % 8 + 1) ELSE (x + 7) % 8 + 1 END AS x, CASE WHEN y > 6 THEN 12 - y ELSE y END AS y FROM a)
SELECT i, j, n FROM b JOIN f ON c = x - 1 + (y - 1) * 8""",
    "items_by_level": base._GRIDS + """, g AS (SELECT cell_id, l_linenumber AS k, count(*)::DOUBLE AS value FROM items GROUP BY 1, 2),
sums AS (SELECT w.dst, g.k, sum(w.area * g.value) AS value FROM w JOIN g ON g.cell_id = w.src GROUP BY 1, 2)
SELECT da.cell_id, (t.k - 1)::INTEGER AS level, round(coalesce(s.value, 0) / da.area, 6) AS value FROM da CROSS JOIN range(1, 8) t(k) LEFT JOIN sums s ON s.dst = da.cell_id AND s.k = t.k""",
    "customers_near_suppliers": base._POINTS + f", {_SUPPLIERS} SELECT region_id, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT region_id, s_nationkey, {base._unit('lon', 'lat')} AS a FROM s) u JOIN (SELECT id, {base._unit('lon', 'lat')} AS b FROM p) v ON acos(greatest(least({_DOT}, 1), -1)) <= radians(s_nationkey * 0.375::DOUBLE + 2.7::DOUBLE) GROUP BY region_id",
    "customers_in_triangles": base._POINTS + f", {_SUPPLIERS} SELECT region_id, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT region_id, {base._unit('lon', 'lat')} AS a, {base._unit('(lon + 14.2::DOUBLE)', '(lat + 1.1::DOUBLE)')} AS b, {base._unit('(lon + 3.3::DOUBLE)', '(lat + 9.1::DOUBLE)')} AS c FROM s) u JOIN (SELECT id, {base._unit('lon', 'lat')} AS q FROM p) v ON {_side('a', 'b')} AND {_side('b', 'c')} AND {_side('c', 'a')} GROUP BY region_id",
}
