"""Queries over the given tables, one or more per operator."""

from shopmill.queries import catalogs, product_pages, ranking, reports, scalars, stored_pages  # noqa: F401
from shopmill.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
