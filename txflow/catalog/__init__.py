"""Registered queries over the test tables, one module per area."""

from importlib import import_module

AREAS = ("sources", "scalars", "joins", "aggregates", "windows", "sets", "quality", "drift", "graphs", "learning", "streams")


def load():
    from txflow.catalog import registry

    for area in AREAS:
        import_module(f"txflow.catalog.{area}")
    return registry.QUERIES, registry.ORACLES
