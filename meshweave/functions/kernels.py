"""Areas of polygon intersections for whole batches of pairs, in numpy.

Rings are padded arrays (pair, vertex, coordinate) with their numbers of vertices.
"""

from __future__ import annotations

import numpy as np


def padded(offsets: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings one after another as (ring, vertex, coordinate), filled with zeros."""
    size = np.diff(offsets)
    out = np.zeros((len(size), max(1, int(size.max(initial=1))), points.shape[1]))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], size)] = points[offsets[0] : offsets[-1]]
    return out, size


def _at(rings: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Vertex k of each ring, beyond the last from the start again."""
    return rings[np.arange(len(rings)), np.where(k < size, k, 0)]


#: Rings of more vertices are taken whole instead of vertex by vertex.
LONG = 256
#: Crossings of edges and slabs looked at together when a polygon is cut.
AT_ONCE = 1 << 21


def _following(rings: np.ndarray, size: np.ndarray, by: int = 1) -> np.ndarray:
    """All rings turned by ``by`` vertices."""
    place = (np.arange(rings.shape[1])[None, :] + by) % np.maximum(size, 1)[:, None]
    return np.take_along_axis(rings, place[:, :, None], 1)


def planar_areas(rings: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed areas; vertices are taken from the first one, so that small cells lose no digits."""
    origin = rings[:, :1]
    if rings.shape[1] > LONG:
        a, b = rings - origin, _following(rings, size) - origin
        real = np.arange(rings.shape[1])[None, :] < size[:, None]
        return np.where(real, a[:, :, 0] * b[:, :, 1] - b[:, :, 0] * a[:, :, 1], 0.0).sum(axis=1) / 2
    total = np.zeros(len(rings))
    for k in range(rings.shape[1]):
        a, b = _at(rings, size, k) - origin[:, 0], _at(rings, size, k + 1) - origin[:, 0]
        total += np.where(k < size, a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1], 0.0)
    return total / 2


def spherical_areas(rings: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed solid angles, as fans from the first vertex."""
    first, total = rings[:, 0], np.zeros(len(rings))
    for k in range(1, rings.shape[1] - 1):
        b, c = _at(rings, size, k), _at(rings, size, k + 1)
        # a . (b x c) from differences: the triple product of nearly equal vectors would lose digits
        triple = np.einsum("ij,ij->i", first, np.cross(b - first, c - first))
        angle = 2 * np.arctan2(triple, 1 + np.einsum("ij,ij->i", first, b) + np.einsum("ij,ij->i", b, c) + np.einsum("ij,ij->i", c, first))
        total += np.where(k + 1 < size, angle, 0.0)
    return total


#: Caps are enlarged by this factor, so that rounding excludes no neighbour.
SLACK = 1.0001


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between unit vectors, in radians."""
    return np.arctan2(np.linalg.norm(np.cross(a, b), axis=-1), (a * b).sum(axis=-1))


def caps(rings: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Center and radius (radians) of a spherical cap around each ring's vertices and edge midpoints.

    The center is the normalized mean of the vertices; where that vanishes the cap is the whole sphere.
    """
    real = np.arange(rings.shape[1])[None, :] < size[:, None]
    total = (rings * real[:, :, None]).sum(axis=1)
    length = np.linalg.norm(total, axis=1)
    whole = length < 1e-12
    center = np.where(whole[:, None], [0.0, 0.0, 1.0], total / np.maximum(length, 1e-300)[:, None])
    radius = np.zeros(len(rings))
    for k in range(rings.shape[1]):
        a, b = _at(rings, size, k), _at(rings, size, k + 1)
        middle = a + b
        middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-300)
        radius = np.maximum(radius, np.where(k < size, np.maximum(angles(center, a), angles(center, middle)), 0))
    return center, np.where(whole, np.nextafter(np.pi, 4), radius * SLACK)


def counterclockwise(rings: np.ndarray, size: np.ndarray, spherical: bool) -> np.ndarray:
    signed = spherical_areas(rings, size) if spherical else planar_areas(rings, size)
    turned = rings.copy()
    place = np.arange(rings.shape[1])[None, :]
    back = np.where(place < size[:, None], size[:, None] - 1 - place, place)
    flip = signed < 0
    turned[flip] = np.take_along_axis(rings[flip], back[flip][:, :, None], axis=1)
    return turned


def clip(subject: np.ndarray, n: np.ndarray, window: np.ndarray, m: np.ndarray, spherical: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sutherland-Hodgman: each subject ring within its convex, counterclockwise window ring."""
    n = n.copy()
    for k in range(window.shape[1]):
        a, b = _at(window, m, k), _at(window, m, k + 1)
        if spherical:
            normal = np.cross(a, b)
            length = np.linalg.norm(normal, axis=1)
            side = np.einsum("ivd,id->iv", subject, normal / np.maximum(length, 1e-300)[:, None])
        else:
            edge = b - a
            length = np.abs(edge).max(axis=1)
            side = edge[:, None, 0] * (subject[:, :, 1] - a[:, None, 1]) - edge[:, None, 1] * (subject[:, :, 0] - a[:, None, 0])
        cut = (k < m) & (length > 1e-14 if spherical else length > 0)
        if spherical:
            side[np.abs(side) < 1e-15] = 0.0
        place = np.arange(subject.shape[1])[None, :]
        real = place < n[:, None]
        nxt = np.where(place + 1 < n[:, None], place + 1, 0)
        other, far = np.take_along_axis(side, nxt, 1), np.take_along_axis(subject, nxt[:, :, None], 1)
        keep = real & ((side >= 0) | ~cut[:, None])
        cross = real & cut[:, None] & (side * other < 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(cross, side / (side - other), 0.0)
        met = subject + t[:, :, None] * (far - subject)
        if spherical:
            met = met / np.maximum(np.linalg.norm(met, axis=2, keepdims=True), 1e-300)
        both = np.stack([subject, met], axis=2).reshape(len(subject), -1, subject.shape[2])
        mask = np.stack([keep, cross], axis=2).reshape(len(subject), -1)
        n = mask.sum(axis=1)
        order = np.argsort(~mask, axis=1, kind="stable")[:, : max(1, int(n.max(initial=1)))]
        subject = np.take_along_axis(both, order[:, :, None], axis=1)
    return subject, n


def convex(rings: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which counterclockwise rings are convex: none of their corners turns right."""
    if rings.shape[1] > LONG and rings.shape[2] == 2:
        a, b, c = rings, _following(rings, size), _following(rings, size, 2)
        turn = (b[:, :, 0] - a[:, :, 0]) * (c[:, :, 1] - b[:, :, 1]) - (b[:, :, 1] - a[:, :, 1]) * (c[:, :, 0] - b[:, :, 0])
        real = np.arange(rings.shape[1])[None, :] < size[:, None]
        return (~real | (turn >= -1e-12 * (1 + np.abs(a).max(axis=2)) ** 2)).all(axis=1)
    out = np.ones(len(rings), bool)
    for k in range(rings.shape[1]):
        a, b = _at(rings, size, k), _at(rings, size, k + 1)
        c = rings[np.arange(len(rings)), np.where(k < size, (k + 2) % np.maximum(size, 1), 0)]
        if rings.shape[2] == 3:
            turn = np.einsum("ij,ij->i", b, np.cross(c - b, a - b))
        else:
            turn = (b[:, 0] - a[:, 0]) * (c[:, 1] - b[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - b[:, 0])
        out &= (k >= size) | (turn >= -1e-12 * (1 + np.abs(a).max(axis=1)) ** 2)
    return out


def trapezoids(rings: list[np.ndarray]) -> np.ndarray:
    """(part, 4, 2) counterclockwise trapezoids, with two sides along an axis, that make up a simple polygon and its holes.

    The plane is cut at every vertex, at its height or, where edges then go through fewer slabs, at its abscissa.
    """
    a = np.concatenate(rings)
    b = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    through = []
    for axis in (0, 1):
        ends = np.searchsorted(np.unique(a[:, axis]), [a[:, axis], b[:, axis]])
        through.append(int(np.abs(ends[1] - ends[0]).sum()))
    # coordinates changed about are seen in a mirror, which turns the parts
    return _level_trapezoids(a, b) if through[1] <= through[0] else _level_trapezoids(a[:, ::-1], b[:, ::-1])[:, ::-1, ::-1]


def _runs(left: np.ndarray, right: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Slabs first to last between the same two edges, where one follows another as one."""
    order = np.lexsort((first, right, left))
    left, right, first, last = left[order], right[order], first[order], last[order]
    new = np.ones(len(left), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1]) | (first[1:] != last[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(left))[: len(begin)] - 1
    return left[begin], right[begin], first[begin], last[end]


def _level_trapezoids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Trapezoids with level sides inside the edges from ``a`` to ``b``.

    The plane is cut at the height of every vertex; between two heights the edges, sorted, bound the inside pairwise.
    A trapezoid goes on from one height to the next while its two edges do, so there are about as many as vertices.
    Slabs are taken a few at a time, as many as have ``AT_ONCE`` edges.
    """
    up = a[:, 1] < b[:, 1]
    low, high = np.where(up[:, None], a, b), np.where(up[:, None], b, a)
    real = low[:, 1] < high[:, 1]
    low, high = low[real], high[real]
    y = np.unique(a[:, 1])
    first, last = np.searchsorted(y, low[:, 1]), np.searchsorted(y, high[:, 1])
    slope = (high[:, 0] - low[:, 0]) / (high[:, 1] - low[:, 1])

    def x(edge: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = low[edge, 0] + (at - low[edge, 1]) * slope[edge]
        return np.where(at == high[edge, 1], high[edge, 0], found)

    crossed = np.cumsum(np.cumsum(np.bincount(first, minlength=len(y)) - np.bincount(last, minlength=len(y)))[: len(y) - 1])
    found, begin = [], 0
    while begin < len(crossed):
        before = crossed[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(crossed, before + AT_ONCE, side="right")))
        some = np.flatnonzero((first < end) & (last > begin))
        start, count = np.maximum(first[some], begin), np.minimum(last[some], end) - np.maximum(first[some], begin)
        edge = np.repeat(some, count)
        slab = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count - start, count)
        order = np.lexsort((x(edge, (y[slab] + y[slab + 1]) / 2), slab))
        left, right, slab = edge[order[::2]], edge[order[1::2]], slab[order[::2]]
        found.append(_runs(left, right, slab, slab + 1))
        begin = end
    left, right, bottom, top = _runs(*map(np.concatenate, zip(*found, strict=True))) if found else [np.zeros(0, int)] * 4
    bottom, top = y[bottom], y[top]
    return np.stack([np.column_stack(p) for p in ((x(left, bottom), bottom), (x(right, bottom), bottom), (x(right, top), top), (x(left, top), top))], axis=1)


def convex_parts(ring: np.ndarray, holes: list[np.ndarray]) -> list[np.ndarray]:
    """Convex rings that make up a cell: the ring itself where it is convex, else trapezoids.

    A spherical ring (unit vectors) is cut in the plane that touches the sphere at its middle, where great circles are lines.
    One that reaches a quarter of the sphere's circumference from there is taken to be convex.
    """
    if ring.shape[1] == 2:
        flat = ring
    else:
        middle = ring.mean(axis=0)
        middle /= max(np.linalg.norm(middle), 1e-300)
        if (ring @ middle <= 1e-6).any():
            return [ring]
        east = np.cross(middle, [1.0, 0, 0] if abs(middle[0]) < 0.7 else [0, 1.0, 0])
        east /= np.linalg.norm(east)
        frame = np.stack([east, np.cross(middle, east)])
        flat = (ring @ frame.T) / (ring @ middle)[:, None]
    size = np.array([len(flat)])
    if not holes and convex(counterclockwise(flat[None], size, False), size)[0]:
        return [ring]
    parts = trapezoids([flat, *holes])
    if ring.shape[1] == 2:
        return list(parts)
    out = middle + parts @ frame
    return list(out / np.linalg.norm(out, axis=2, keepdims=True))


def intersection_areas(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, spherical: bool) -> np.ndarray:
    """Unsigned area of each pair's intersection; all cells are convex."""
    a, b = counterclockwise(a, n, spherical), counterclockwise(b, m, spherical)
    ring, size = clip(a, n, b, m, spherical)
    return np.where(size > 2, np.abs(spherical_areas(ring, size) if spherical else planar_areas(ring, size)), 0.0)
