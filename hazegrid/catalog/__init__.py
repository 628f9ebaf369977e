"""All registered queries."""

from importlib import import_module

AREAS = ("intake", "scalars", "cleaning", "panel", "profiling", "serving", "learning", "streams", "nullkeys")


def load_all():
    from hazegrid.catalog.base import REGISTRY

    for area in AREAS:
        import_module(f"hazegrid.catalog.{area}")
    return REGISTRY
