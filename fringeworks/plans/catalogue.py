"""All queries of the catalogue."""

from . import arrays, extras, imaging, rows, solvers  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
