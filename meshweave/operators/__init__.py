"""Candidate joins, regridders and what is done with them."""

from .candidates import candidate_pairs
from .regridder import Regridder, build_regridder

__all__ = ["Regridder", "build_regridder", "candidate_pairs"]
