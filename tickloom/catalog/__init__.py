"""Registered queries: one per operator, each with the SQL it must agree with."""

from __future__ import annotations


def load():
    """All registered queries and their SQL texts."""
    import importlib
    import pkgutil

    from tickloom.catalog import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
