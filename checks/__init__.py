"""Registered queries: one per operator, each with its SQL counterpart."""

import importlib

MODULES = ["scalar", "rasters", "spatial", "graphs", "tables", "networks"]


def load_all():
    for m in MODULES:
        try:
            importlib.import_module(f"checks.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"checks.{m}":
                raise
    return importlib.import_module("checks.registry")
