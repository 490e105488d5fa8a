"""Registered queries. ``load`` imports every query module and returns the registry."""

from __future__ import annotations

import importlib

MODULES = (
    "rasters", "projects", "ledger", "experiment", "compose", "fidelity", "layers", "motion", "signals", "documents", "metrics", "families",
)


def load():
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    from .registry import REGISTRY

    return REGISTRY
