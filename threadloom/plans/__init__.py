"""Query registry and the modules that fill it."""

import importlib

MODULES: tuple[str, ...] = ("eda", "text", "analysis", "models")


def load_all():
    """The registry, with every module of queries imported."""
    for name in MODULES:
        importlib.import_module(f"threadloom.plans.{name}")
    return importlib.import_module("threadloom.plans.registry")
