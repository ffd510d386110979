"""Grids: every constructor returns a :class:`~meshweave.sources.grid.Grid` of one row per cell."""

from .grid import Grid, as_grid, union_grids
from .grids import corner_grid, cubed_sphere, fold_grid, healpix_grid, latlon_grid, polygon_grid, regular_grid, ring_grid, rotated_latlon_grid
from .tripolar import tripolar_grid

__all__ = ["Grid", "as_grid", "corner_grid", "cubed_sphere", "fold_grid", "healpix_grid", "latlon_grid", "polygon_grid", "regular_grid", "ring_grid", "rotated_latlon_grid", "tripolar_grid", "union_grids"]
