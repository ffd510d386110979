"""Symmetric quadrature rules for triangles (Dunavant 1985) and fans of triangles."""

from __future__ import annotations

from itertools import permutations

import numpy as np

#: Fixed published values: for each degree, orbits of barycentric points with the weight of each point; weights add up to 1.
ORBITS = {
    1: [((1 / 3, 1 / 3, 1 / 3), 1.0)],
    2: [((2 / 3, 1 / 6, 1 / 6), 1 / 3)],
    3: [((1 / 3, 1 / 3, 1 / 3), -0.5625), ((0.6, 0.2, 0.2), 25 / 48)],
    4: [((0.108103018168070, 0.445948490915965, 0.445948490915965), 0.223381589678011), ((0.816847572980459, 0.091576213509771, 0.091576213509771), 0.109951743655322)],
    5: [((1 / 3, 1 / 3, 1 / 3), 0.225), ((0.059715871789770, 0.470142064105115, 0.470142064105115), 0.132394152788506), ((0.797426985353087, 0.101286507323456, 0.101286507323456), 0.125939180544827)],
    6: [((0.501426509658179, 0.249286745170910, 0.249286745170910), 0.116786275726379), ((0.873821971016996, 0.063089014491502, 0.063089014491502), 0.050844906370207), ((0.053145049844817, 0.310352451033784, 0.636502499121399), 0.082851075618374)],
    7: [((1 / 3, 1 / 3, 1 / 3), -0.149570044467682), ((0.479308067841920, 0.260345966079040, 0.260345966079040), 0.175615257433208), ((0.869739794195568, 0.065130102902216, 0.065130102902216), 0.053347235608838), ((0.048690315425316, 0.312865496004874, 0.638444188569810), 0.077113760890257)],
    8: [((1 / 3, 1 / 3, 1 / 3), 0.144315607677787), ((0.081414823414554, 0.459292588292723, 0.459292588292723), 0.095091634267285), ((0.658861384496480, 0.170569307751760, 0.170569307751760), 0.103217370534718), ((0.898905543365938, 0.050547228317031, 0.050547228317031), 0.032458497623198), ((0.008394777409958, 0.263112829634638, 0.728492392955404), 0.027230314174435)],
}


def reference_rule(degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Barycentric points (n, 3) and weights that add up to 1/2, exact to ``degree``."""
    if not 1 <= degree <= max(ORBITS):
        raise ValueError(f"no triangle rule of degree {degree}")
    points, weights = [], []
    for point, weight in ORBITS[degree]:
        for p in sorted(set(permutations(point))):
            points.append(p)
            weights.append(weight / 2)
    return np.array(points), np.array(weights)


def fan_triangulate(vertices: np.ndarray) -> np.ndarray:
    """(n, 3, d) triangles from the vertices' mean to each edge; none for fewer than 3 vertices."""
    vertices = np.asarray(vertices, float)
    if len(vertices) < 3:
        return np.zeros((0, 3, vertices.shape[1] if vertices.ndim > 1 else 2))
    middle = np.broadcast_to(vertices.mean(axis=0), vertices.shape)
    return np.stack([middle, vertices, np.roll(vertices, -1, axis=0)], axis=1)


def planar_triangle_area(a, b, c) -> float:
    return abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2


def spherical_means(rings: np.ndarray, size: np.ndarray, f, degree: int = 8) -> np.ndarray:
    """Means of ``f`` (of unit vectors, vectorised) over padded spherical polygons; 0 for those without area.

    Each is a fan of triangles from its first vertex; ``f`` is called once for the points of all.
    """
    points, weights = reference_rule(degree)
    of, k = np.nonzero(np.arange(2, rings.shape[1])[None, :] < size[:, None])
    triangles = np.stack([rings[of, 0], rings[of, k + 1], rings[of, k + 2]], axis=1)
    p = points @ triangles
    length = np.maximum(np.linalg.norm(p, axis=2), 1e-300)
    volume = np.abs((triangles[:, 0] * np.cross(triangles[:, 1], triangles[:, 2])).sum(axis=1))
    j = weights[None, :] * volume[:, None] / length**3
    values = np.asarray(f((p / length[:, :, None]).reshape(-1, 3)), float).reshape(j.shape)
    total = np.bincount(of, (j * values).sum(axis=1), len(rings))
    area = np.bincount(of, j.sum(axis=1), len(rings))
    return np.where(area > 0, total / np.where(area > 0, area, 1), 0.0)


def spherical_mean(ring: np.ndarray, f, degree: int = 8) -> float:
    """The same for one polygon."""
    return float(spherical_means(np.asarray(ring, float)[None], np.array([len(ring)]), f, degree)[0])


def gauss_lobatto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes on [-1, 1] with both ends, and weights; exact to degree 2n - 3."""
    legendre = np.polynomial.Legendre.basis(n - 1)
    nodes = np.concatenate([[-1.0], np.sort(legendre.deriv().roots().real), [1.0]]) if n > 2 else np.array([-1.0, 1.0])
    return nodes, 2 / (n * (n - 1) * legendre(nodes) ** 2)


def lagrange(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(len(x), len(nodes)) values of the Lagrange basis."""
    x = np.asarray(x, float)
    out = np.ones((len(x), len(nodes)))
    for i, a in enumerate(nodes):
        for j, b in enumerate(nodes):
            if i != j:
                out[:, i] *= (x - b) / (a - b)
    return out
