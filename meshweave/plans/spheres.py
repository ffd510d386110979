"""Registered queries on spherical grids cell by cell and on spectral elements, with fields that are counts from the tables."""

from __future__ import annotations

from collections.abc import Callable
from math import cos, pi, radians, sin, tan

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quadrature import reference_rule
from ..functions.shared import written
from ..operators.fields import cell_means
from ..operators.metrics import average_coincident, mirror_fold
from ..operators.regridder import build_regridder
from ..operators.spectral import SpectralSpace, cells_to_nodes, element_masses, nodes_to_cells
from ..sources import cubed_sphere, healpix_grid, latlon_grid, ring_grid, rotated_latlon_grid, tripolar_grid
from ..sources.grid import Grid, part_of
from ..sources.grids import CUBE, JPLL, JRLL
from ..sources.tripolar import fold_sizes
from . import queries as base

NE, NQ = 2, 3
TRI = {"nx": 24, "ny": 12, "cap": 5}


def order_counts(spark: SparkSession, sf_dir: str, cells: int) -> DataFrame:
    """Orders dealt to cells (or nodes) by their keys."""
    cell = (F.pmod(F.col("o_orderkey").cast("bigint") * 7919, F.lit(cells)) + 1).alias("cell_id")
    return base.table(spark, sf_dir, "orders").groupBy(cell).agg(F.count(F.lit(1)).cast("double").alias("value"))


def written_grid(grid: Grid) -> Grid:
    """The grid with corners that are computed once."""
    return Grid(written(grid.cells), grid.shape, grid.manifold, grid.kind)


def linear_means_on_spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of cells that have orders, and means of 2 + z + x/2 over them, on every family of spherical grids."""
    grids = {"healpix": healpix_grid(spark, 8), "cubed": cubed_sphere(spark, 8), "rings": ring_grid(spark, [82.5 - 15 * k for k in range(12)], 24), "rotated": rotated_latlon_grid(spark, 36, 18, (40.0, 60.0)), "tripolar": tripolar_grid(spark, **TRI)}
    out = None
    for name, grid in grids.items():
        grid = written_grid(grid)
        means = cell_means(grid, lambda lon, lat: 2 + np.sin(np.radians(lat)) + np.cos(np.radians(lat)) * np.cos(np.radians(lon)) / 2).data.withColumnRenamed("value", "mean")
        one = means.join(grid.areas(), "cell_id").join(order_counts(spark, sf_dir, grid.n_cells), "cell_id")
        one = one.select(F.lit(name).alias("grid"), "cell_id", F.round("area", 7).alias("area"), F.round("mean", 6).alias("mean"), F.col("value").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def orders_coarsened_on_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts on a cube's cells, on cells twice as wide."""
    dst, src = (written_grid(cubed_sphere(spark, n)) for n in (4, 8))
    return build_regridder(dst, src).regrid(order_counts(spark, sf_dir, src.n_cells)).select("cell_id", F.round("value", 6).alias("value"))


def orders_on_folded_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a tripolar grid folded through centers: area, part and number in it, and order counts with the fold's twins."""
    grid = written_grid(tripolar_grid(spark, **TRI, fold="center"))
    nx, ny = grid.shape
    part, local = part_of(F.col("cell_id"), fold_sizes(nx, ny))
    field = mirror_fold(order_counts(spark, sf_dir, nx * ny), nx, ny)
    return grid.areas().join(field, "cell_id").select("cell_id", part.alias("part"), local.alias("local"), F.round("area", 7).alias("area"), "value")


def orders_from_tripolar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts on a tripolar grid, in bands of latitude: all of the cap in one, and slices of the rows south of it."""
    src = written_grid(tripolar_grid(spark, 24, 12, 5, south=-90.0, join=0.0, pole=0.0))
    r = build_regridder(latlon_grid(spark, 4, 2), src)
    return r.regrid(order_counts(spark, sf_dir, src.n_cells)).where("cell_id <= 4").select("cell_id", F.round("value", 6).alias("value"))


def orders_from_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts at the nodes of spectral elements, as means over cells of which four lie in an element."""
    space = SpectralSpace(spark, NE, NQ)
    r = nodes_to_cells(space, written_grid(cubed_sphere(spark, 2 * NE)))
    return r.regrid(order_counts(spark, sf_dir, space.n_nodes)).select("cell_id", F.round("value", 5).alias("value"))


def orders_at_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass matrices of elements times order counts at their nodes."""
    space = SpectralSpace(spark, NE, NQ)
    field = order_counts(spark, sf_dir, space.n_nodes).withColumnRenamed("cell_id", "other_id")
    return element_masses(space).join(field, "other_id").groupBy("node_id").agg(F.round(F.sum(F.col("mass") * F.col("value")), 6).alias("moment"))


def orders_projected_on_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts on cells, projected onto nodes: its moments are those of the cells, whatever solved for it."""
    space, cells = SpectralSpace(spark, NE, NQ), written_grid(cubed_sphere(spark, 2 * NE))
    field = order_counts(spark, sf_dir, cells.n_cells)
    nodal = cells_to_nodes(space, cells).regrid(field).select(F.col("cell_id").alias("other_id"), "value")
    whole = nodes_to_cells(space, cells).weights.groupBy(F.col("src").alias("node_id")).agg(F.sum("area").alias("whole"))
    moments = element_masses(space).join(nodal, "other_id").groupBy("node_id").agg(F.sum(F.col("mass") * F.col("value")).alias("moment"), F.sum("mass").alias("all"))
    return moments.join(whole, "node_id").select("node_id", F.round(F.col("moment") * F.col("whole") / F.col("all"), 6).alias("moment"))


def orders_at_shared_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts at nodes, averaged over the copies that elements have of one place."""
    space = SpectralSpace(spark, NE, NQ)
    field = order_counts(spark, sf_dir, space.n_nodes).withColumnRenamed("cell_id", "node_id")
    return average_coincident(field.join(space.shared_nodes(), "node_id")).select("node_id", "global_node", F.round("weight", 9).alias("weight"), F.round("value", 6).alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (linear_means_on_spheres, orders_coarsened_on_cube, orders_on_folded_cap, orders_from_tripolar, orders_from_nodes, orders_at_mass, orders_projected_on_nodes, orders_at_shared_nodes)}


def _num(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def _counts(cells: str) -> str:
    return f"SELECT ((o_orderkey::BIGINT * 7919) % {cells} + 1)::BIGINT AS cell_id, count(*)::DOUBLE AS value FROM orders GROUP BY 1"


#: The cube's faces: number, center c and axes a, b.
_CUBE = "cube(face, c, a, b) AS (VALUES " + ", ".join(f"({k}, " + ", ".join("{" + ", ".join(f"'{n}': {_num(v)}" for n, v in zip("xyz", p, strict=True)) + "}" for p in face) + ")" for k, face in enumerate(CUBE)) + ")"


def _unit(x: str, y: str, z: str) -> str:
    length = f"sqrt(({x}) * ({x}) + ({y}) * ({y}) + ({z}) * ({z}))"
    return f"{{'x': ({x}) / {length}, 'y': ({y}) / {length}, 'z': ({z}) / {length}}}"


def _cubed(ne: int) -> str:
    """cell_id, face, i, j and corners p, q, r, s of a cube's cells."""

    def corner(di: int, dj: int) -> str:
        u, v = (f"tan(((k.{k} + {d}) * {_num(2 / ne)} - 1) * {_num(pi / 4)})" for k, d in (("i", di), ("j", dj)))
        return _unit(*(f"c.{n} + {u} * a.{n} + {v} * b.{n}" for n in "xyz"))

    corners = ", ".join(f"{corner(*d)} AS {n}" for n, d in zip("pqrs", ((0, 0), (1, 0), (1, 1), (0, 1)), strict=True))
    return f"SELECT (face * {ne * ne} + k.j * {ne} + k.i + 1)::BIGINT AS cell_id, face, k.i AS i, k.j AS j, {corners} FROM cube, (SELECT i, j FROM range({ne}) x(i), range({ne}) y(j)) k"


def _healpix(nside: int) -> str:
    levels = nside.bit_length() - 1
    bits = lambda s: " | ".join(f"(((k >> {2 * n + s}) & 1) << {n})" for n in range(levels))

    def corner(dx: int, dy: int) -> str:
        x, y = f"((ix + {dx}) / {_num(nside)})", f"((iy + {dy}) / {_num(nside)})"
        return f"SELECT cell_id, '{dx}{dy}' AS spot, {list(JRLL)}[face + 1] - {x} - {y} AS jr, {list(JPLL)}[face + 1] AS jp, {x} - {y} AS off FROM hp"

    number = {"11": "p", "01": "q", "00": "r", "10": "s"}
    points = ", ".join(f"any_value({{'x': sqrt(greatest(1 - z * z, 0)) * cos(phi), 'y': sqrt(greatest(1 - z * z, 0)) * sin(phi), 'z': z}}) FILTER (WHERE spot = '{at}') AS {n}" for at, n in number.items())
    corners = " UNION ALL ".join(corner(int(at[0]), int(at[1])) for at in number)
    return f"""WITH hp AS (SELECT cell_id, face, {bits(0)} AS ix, {bits(1)} AS iy FROM (SELECT (n + 1)::BIGINT AS cell_id, n // {nside**2} AS face, n % {nside**2} AS k FROM range({12 * nside**2}) t(n))),
c AS (SELECT *, CASE WHEN jr < 1 THEN jr WHEN jr > 3 THEN 4 - jr ELSE 1 END AS nr FROM ({corners})),
d AS (SELECT *, CASE WHEN jr < 1 THEN 1 - nr * nr / 3 WHEN jr > 3 THEN nr * nr / 3 - 1 ELSE (2 - jr) * 2 / 3 END AS z, CASE WHEN nr < 1e-14 THEN 0 ELSE (jp * nr + off) / nr * {_num(pi / 4)} END AS phi FROM c)
SELECT cell_id, {points} FROM d GROUP BY 1"""


def _lattice(nx: int, ny: int, number: str, lon: Callable[[str], str], lat: Callable[[str], str]) -> str:
    corners = ", ".join(f"{base._unit(lon(a), lat(b))} AS {n}" for n, a, b in (("p", "i", "j"), ("q", "(i + 1)", "j"), ("r", "(i + 1)", "(j + 1)"), ("s", "i", "(j + 1)")))
    return f"SELECT ({number})::BIGINT AS cell_id, {corners} FROM range({nx}) x(i), range({ny}) y(j)"


def _rotated() -> str:
    inner = _lattice(36, 18, "i + 1 + j * 36", lambda i: f"{i} * 10::DOUBLE", lambda j: f"({j} * 10::DOUBLE - 90)")
    a, b = radians(40), radians(30)
    rows = ((cos(a) * cos(b), -sin(a), cos(a) * sin(b)), (sin(a) * cos(b), cos(a), sin(a) * sin(b)), (-sin(b), 0.0, cos(b)))
    turned = ", ".join("{" + ", ".join(f"'{n}': " + " + ".join(f"{_num(v)} * {p}.{m}" for v, m in zip(row, "xyz", strict=True)) for n, row in zip("xyz", rows, strict=True)) + f"}} AS {p}" for p in "pqrs")
    return f"SELECT cell_id, {turned} FROM ({inner})"


def _tripolar(nx: int, ny: int, cap: int, *, south: float = -80.0, join: float = 60.0, pole: float = 70.0, center: bool = False) -> str:
    """Corners by angles: a cap's point is a bipolar coordinate pair, turned into longitude and latitude."""
    rows, height = ny - cap, cap - 0.5 if center else cap
    size = tan(radians(90 - join) / 2)
    points = f"""SELECT i, j, CASE WHEN j <= {rows} THEN radians({_num(pole)} + i * {_num(360 / nx)}) ELSE {_num(radians(pole))} + atan2(b, a) END AS lon,
  CASE WHEN j <= {rows} THEN radians({_num(south)} + j * {_num((join - south) / rows)}) ELSE pi() / 2 - 2 * atan({_num(size)} * sqrt(a * a + b * b)) END AS lat
FROM (SELECT i, j, cos(t) / (1 - cos(g) * abs(sin(t))) AS a, sin(g) * sin(t) / (1 - cos(g) * abs(sin(t))) AS b
  FROM (SELECT i, j, i * {_num(2 * pi / nx)} AS t, pi() / 2 * (1 + (j - {rows}) / {_num(height)}) AS g FROM range({nx + 1}) x(i), range({ny + 1}) y(j)))"""
    return f"""SELECT (a.i + 1 + a.j * {nx})::BIGINT AS cell_id, a.i AS i, a.j AS j, a.v AS p, b.v AS q, c.v AS r, d.v AS s
FROM lattice a JOIN lattice b ON b.i = a.i + 1 AND b.j = a.j JOIN lattice c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN lattice d ON d.i = a.i AND d.j = a.j + 1""".replace("lattice", f"(SELECT i, j, {{'x': cos(lat) * cos(lon), 'y': cos(lat) * sin(lon), 'z': sin(lat)}} AS v FROM ({points}))")


_AREA = f"abs({base._excess('p', 'q', 'r')} + {base._excess('p', 'r', 's')})"


def _edge(a: str, b: str, axis: str) -> str:
    """Component of an edge's unit normal times its length: half of their sum is the integral of the unit vector over a polygon."""
    cross = {"x": f"({a}.y * {b}.z - {a}.z * {b}.y)", "y": f"({a}.z * {b}.x - {a}.x * {b}.z)", "z": f"({a}.x * {b}.y - {a}.y * {b}.x)"}
    length = "sqrt(" + " + ".join(f"{c} * {c}" for c in cross.values()) + ")"
    return f"CASE WHEN {length} < 1e-14 THEN 0 ELSE {cross[axis]} / greatest({length}, 1e-300) * atan2({length}, {a}.x * {b}.x + {a}.y * {b}.y + {a}.z * {b}.z) END"


def _linear(name: str, cells: str, n: int) -> str:
    edges = [(a, b) for a, b in zip("pqrs", "qrsp", strict=True)]
    z, x = (" + ".join(_edge(a, b, axis) for a, b in edges) for axis in "zx")
    signed = f"({base._excess('p', 'q', 'r')} + {base._excess('p', 'r', 's')})"
    return f"SELECT '{name}' AS grid, g.cell_id, round({_AREA}, 7) AS area, round(2 + (({z}) + ({x}) / 2) / 2 / {signed}, 6) AS mean, o.value AS n FROM ({cells}) g JOIN ({_counts(n)}) o ON o.cell_id = g.cell_id"


_POINTS, _WEIGHTS = reference_rule(2 * (NQ - 1))
_RULE = "rule(w, b0, b1, b2) AS (VALUES " + ", ".join(f"({_num(2 * w)}, {', '.join(map(_num, p))})" for p, w in zip(_POINTS, _WEIGHTS, strict=True)) + ")"
_BASIS = ("({s} * ({s} - 1) / 2)", "(1 - {s} * {s})", "({s} * ({s} + 1) / 2)")


def _at(k: str, s: str) -> str:
    return f"CASE {k} WHEN 0 THEN {_BASIS[0]} WHEN 1 THEN {_BASIS[1]} ELSE {_BASIS[2]} END".replace("{s}", s)


def _add(*terms: tuple[str, str]) -> str:
    return _unit(*(" + ".join(f"{w} * {p}.{n}" for w, p in terms) for n in "xyz"))


#: Integrals of an element's basis functions over the four cells in it: cell_id, node_id, b.
_INTEGRALS = f"""
WITH {_CUBE}, {_RULE},
cells AS ({_cubed(2 * NE)}),
fans AS (SELECT cell_id, face, i // 2 AS i, j // 2 AS j, m, unnest([{{'u': p, 'v': q}}, {{'u': q, 'v': r}}, {{'u': r, 'v': s}}, {{'u': s, 'v': p}}]) AS e FROM (SELECT *, {_add(*[("1", n) for n in "pqrs"])} AS m FROM cells)),
tri AS (SELECT cell_id, face, i, j, m, e.u AS u, e.v AS v FROM fans),
pts AS (SELECT cell_id, t.face, i, j, rule.w * abs({base._excess('m', 'u', 'v')}) AS w, {_add(("b0", "m"), ("b1", "u"), ("b2", "v"))} AS t FROM tri t, rule),
loc AS (SELECT cell_id, pts.face, i, j, w, {", ".join(f"((atan2(t.x * {ax}.x + t.y * {ax}.y + t.z * {ax}.z, t.x * c.x + t.y * c.y + t.z * c.z) / {_num(pi / 4)} + 1) * {NE} / 2 - {k}) * 2 - 1 AS {name}" for ax, k, name in (("a", "i", "xi"), ("b", "j", "eta")))} FROM pts JOIN cube ON cube.face = pts.face),
ints AS (SELECT cell_id, ((face * {NE * NE} + j * {NE} + i) * 9 + q.k * 3 + p.k + 1)::BIGINT AS node_id, sum(w * {_at('p.k', 'xi')} * {_at('q.k', 'eta')}) AS b FROM loc, range(3) p(k), range(3) q(k) GROUP BY 1, 2)
"""
_LOBATTO3 = "(VALUES (0, -1::DOUBLE, 1::DOUBLE / 3), (1, 0::DOUBLE, 4::DOUBLE / 3), (2, 1::DOUBLE, 1::DOUBLE / 3))"
_LOBATTO5 = "(VALUES (-1::DOUBLE, 0.1::DOUBLE), (-sqrt(3::DOUBLE / 7), 49::DOUBLE / 90), (0::DOUBLE, 32::DOUBLE / 45), (sqrt(3::DOUBLE / 7), 49::DOUBLE / 90), (1::DOUBLE, 0.1::DOUBLE))"


def _jacobian(i: str, xi: str, j: str, eta: str) -> str:
    u, v = (f"tan({_num(pi / 4)} * (({k} + ({s} + 1) / 2) * 2 / {NE} - 1))" for k, s in ((i, xi), (j, eta)))
    return f"(1 + {u} * {u}) * (1 + {v} * {v}) / pow(1 + {u} * {u} + {v} * {v}, 1.5) * {_num((pi / (4 * NE)) ** 2)}"


_MASS = f"""
WITH el AS (SELECT (f * {NE * NE} + j * {NE} + i) AS e, i, j FROM range(6) x(f), range({NE}) y(i), range({NE}) z(j)),
g AS (SELECT e, a.x AS xi, b.x AS eta, a.w * b.w * {_jacobian('i', 'a.x', 'j', 'b.x')} AS w FROM el, {_LOBATTO5} a(x, w), {_LOBATTO5} b(x, w)),
basis AS (SELECT e, xi, eta, w, q.k * 3 + p.k AS k, {_at('p.k', 'xi')} * {_at('q.k', 'eta')} AS v FROM g, range(3) p(k), range(3) q(k)),
mass AS (SELECT a.e, a.k, b.k AS l, sum(a.w * a.v * b.v) AS m FROM basis a JOIN basis b ON a.e = b.e AND a.xi = b.xi AND a.eta = b.eta GROUP BY 1, 2, 3)
"""
_NODES = f"""
WITH {_CUBE},
el AS (SELECT f.face, i, j, (f.face * {NE * NE} + j * {NE} + i) * 9 AS first, c, a, b FROM cube f, range({NE}) y(i), range({NE}) z(j)),
pt AS (SELECT (first + q.k * 3 + p.k + 1)::BIGINT AS node_id, p.w * q.w * {_jacobian('i', 'p.x', 'j', 'q.x')} AS weight,
  {_unit(*(f"c.{n} + tan({_num(pi / 4)} * ((i + (p.x + 1) / 2) * 2 / {NE} - 1)) * a.{n} + tan({_num(pi / 4)} * ((j + (q.x + 1) / 2) * 2 / {NE} - 1)) * b.{n}" for n in "xyz"))} AS v FROM el, {_LOBATTO3} p(k, x, w), {_LOBATTO3} q(k, x, w)),
nodes AS (SELECT node_id, weight, min(node_id) OVER (PARTITION BY round(v.x, 9) + 0, round(v.y, 9) + 0, round(v.z, 9) + 0) AS global_node FROM pt)
"""

ORACLE_SQL: dict[str, str] = {
    "linear_means_on_spheres": f"WITH {_CUBE}\n" + " UNION ALL ".join(_linear(*x) for x in (("healpix", _healpix(8), 768), ("cubed", _cubed(8), 384), ("rings", _lattice(24, 12, "(11 - j) * 24 + i + 1", lambda i: f"({i} * 15::DOUBLE - 7.5::DOUBLE)", lambda j: f"({j} * 15::DOUBLE - 90)"), 288), ("rotated", _rotated(), 648), ("tripolar", _tripolar(**TRI), 288))),
    "orders_coarsened_on_cube": f"WITH {_CUBE}, fine AS (SELECT *, {_AREA} AS area FROM ({_cubed(8)})), n AS ({_counts(384)}) SELECT (face * 16 + (j // 2) * 4 + i // 2 + 1)::BIGINT AS cell_id, round(sum(area * coalesce(value, 0)) / sum(area), 6) AS value FROM fine LEFT JOIN n ON n.cell_id = fine.cell_id GROUP BY 1",
    "orders_on_folded_cap": f"""WITH n AS ({_counts(288)}), g AS (SELECT cell_id, i + 1 AS i, j + 1 AS j, {_AREA} AS area FROM ({_tripolar(**TRI, center=True)})),
k AS (SELECT g.*, n.value, j = 12 AND (i BETWEEN 7 AND 12 OR i >= 19) AS ghost FROM g JOIN n ON n.cell_id = g.cell_id)
SELECT k.cell_id, CASE WHEN k.j < 12 THEN 1 WHEN k.i <= 12 THEN 2 ELSE 3 END::INTEGER AS part, CASE WHEN k.j < 12 THEN k.cell_id WHEN k.i <= 12 THEN k.i ELSE k.i - 12 END::BIGINT AS local,
  CASE WHEN k.ghost THEN 0 ELSE round(k.area, 7) END AS area, CASE WHEN k.ghost THEN coalesce(t.value, k.value) ELSE k.value END AS value FROM k LEFT JOIN k t ON k.ghost AND t.j = 12 AND t.i = 25 - k.i""",
    "orders_from_tripolar": f"""WITH n AS ({_counts(288)}), g AS (SELECT cell_id, (cell_id - 1) % 24 // 6 + 1 AS slice, {_AREA} AS area FROM ({_tripolar(24, 12, 5, south=-90.0, join=0.0, pole=0.0)}) WHERE cell_id <= 168)
SELECT slice::BIGINT AS cell_id, round(sum(area * coalesce(value, 0)) / {_num(pi / 2)}, 6) AS value FROM g LEFT JOIN n ON n.cell_id = g.cell_id GROUP BY 1""",
    "orders_from_nodes": _INTEGRALS + f", n AS ({_counts('216')}), areas AS (SELECT cell_id, {_AREA} AS area FROM cells) SELECT i.cell_id, round(sum(b * coalesce(n.value, 0)) / any_value(area), 5) AS value FROM ints i JOIN areas a ON a.cell_id = i.cell_id LEFT JOIN n ON n.cell_id = i.node_id GROUP BY 1",
    "orders_at_mass": _MASS + f", n AS ({_counts('216')}) SELECT (e * 9 + k + 1)::BIGINT AS node_id, round(sum(m * n.value), 6) AS moment FROM mass JOIN n ON n.cell_id = e * 9 + l + 1 GROUP BY 1",
    "orders_projected_on_nodes": _INTEGRALS + f", n AS ({_counts('96')}) SELECT i.node_id, round(sum(b * coalesce(n.value, 0)), 6) AS moment FROM ints i LEFT JOIN n ON n.cell_id = i.cell_id GROUP BY 1",
    "orders_at_shared_nodes": _NODES + f", n AS ({_counts('216')}), f AS (SELECT nodes.*, value FROM nodes JOIN n ON n.cell_id = nodes.node_id) SELECT node_id, global_node, round(weight, 9) AS weight, round(sum(weight * value) OVER o / sum(weight) OVER o, 6) AS value FROM f WINDOW o AS (PARTITION BY global_node)",
}
