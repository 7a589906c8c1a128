"""Named queries over the test tables, each with the SQL that must give the same rows."""

from bazaarlens.registry import base, features, kpi, models, profile, quality, reports, sales  # noqa: F401, I001
from bazaarlens.registry import storage  # noqa: F401
from bazaarlens.registry.core import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
