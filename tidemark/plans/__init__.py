"""Queries by name."""

from . import catalog, research  # noqa: F401  both register their queries
