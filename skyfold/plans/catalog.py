"""Imports every query module and exposes the registries."""

from skyfold.plans import extract_queries, grid_queries, record_queries, source_queries  # noqa: F401
from skyfold.plans.registry import ORACLES, QUERIES  # noqa: F401
