"""Named queries on the test tables, each next to the SQL that must give the same rows."""

from catalog.registry import ORACLES, QUERIES
from catalog import columns, files, graphs, questions, relational, texts  # noqa: F401  (fill the registry)

__all__ = ["ORACLES", "QUERIES"]
