"""Queries over the given tables, one per operator, each with the same answer in plain SQL."""

from gridfold.registry import formats, geometry, joins, reports, scalars, tiling  # noqa: F401
from gridfold.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
