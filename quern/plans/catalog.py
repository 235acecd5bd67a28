"""Every registered query of the library proper and the SQL that gives the same rows."""

from . import fit_queries, ml_queries, source_queries, spatial_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
