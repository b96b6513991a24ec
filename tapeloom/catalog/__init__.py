"""Registered queries: each operator on the test tables, with the same result stated in SQL."""

from tapeloom.catalog.spec import Query, all_queries

__all__ = ["Query", "all_queries"]
