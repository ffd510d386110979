"""The surface that cells lie on; metadata of a grid, never a column."""

from __future__ import annotations

from dataclasses import dataclass

#: Unit sphere unless a grid says otherwise.
DEFAULT_RADIUS = 1.0


@dataclass(frozen=True)
class Manifold:
    kind: str
    radius: float = DEFAULT_RADIUS

    def __post_init__(self):
        if self.kind not in ("planar", "spherical"):
            raise ValueError(f"unknown manifold {self.kind!r}")

    @property
    def spherical(self) -> bool:
        return self.kind == "spherical"


PLANAR = Manifold("planar")


def sphere(radius: float = DEFAULT_RADIUS) -> Manifold:
    return Manifold("spherical", float(radius))


def common_manifold(dst: Manifold, src: Manifold) -> Manifold:
    """The manifold of a regridder between two grids; a plane next to the default sphere counts as that sphere."""
    if dst == src:
        return dst
    if {dst, src} == {PLANAR, sphere()}:
        return sphere()
    raise ValueError(f"grids lie on different manifolds: {dst} and {src}")
