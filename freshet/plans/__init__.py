"""Registered queries: freshet operators applied to the driver's tables, with their SQL twins."""

from . import climate, custom, feeds, grid, series, signatures, text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES, Query  # noqa: F401
