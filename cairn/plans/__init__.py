"""Registered queries, by area of the engine."""

from importlib import import_module

AREAS = ("quality", "catalog", "chat", "scan", "graph", "retrieval", "extract", "text", "mutation", "streams")


def load_all() -> None:
    for area in AREAS:
        import_module(f"{__name__}.{area}")
