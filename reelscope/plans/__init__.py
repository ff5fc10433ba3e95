"""Whole-table jobs and the registered queries."""

from importlib import import_module

AREAS = ("scalars", "tables", "texts", "rollups", "scoring", "metrics", "models")


def all_queries():
    """(queries, oracle SQL) of every area."""
    for area in AREAS:
        import_module(f"reelscope.plans.{area}_queries")
    from reelscope.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
