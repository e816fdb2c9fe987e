"""Imports every query module, which fills the registry."""

from checks import queries_calendar, queries_joins, queries_models, queries_rows, queries_series, queries_sources  # noqa: F401
from checks.registry import QUERIES, SQL  # noqa: F401
