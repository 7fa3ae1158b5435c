"""All queries of the library, bound to the adapter views."""

import importlib

MODULES = ["scoring", "relational", "texts", "ingestion", "statistics", "streams"]


def load_all():
    from tidemark.catalog.registry import REGISTRY
    for m in MODULES:
        importlib.import_module(f"tidemark.catalog.{m}")
    return REGISTRY
