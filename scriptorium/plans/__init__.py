"""Derived views and the registry of queries."""

from __future__ import annotations

import importlib
import pkgutil


def load_registry():
    """Import every module of queries and return the registry, by name."""
    from scriptorium.plans.registry import REGISTRY

    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return dict(sorted(REGISTRY.items()))
