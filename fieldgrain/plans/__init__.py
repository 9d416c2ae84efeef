"""Named queries over the given tables."""

from __future__ import annotations

import importlib

from fieldgrain.plans.catalog import QUERIES, Query

MODULES = ["coverage", "metrics", "splits", "spectra", "patches", "association", "planning", "maps", "ledger", "models", "studies", "builds", "training"]


def load_queries() -> dict[str, Query]:
    """Import every query module once and return the registry."""
    for module in MODULES:
        importlib.import_module(f"fieldgrain.plans.{module}")
    return dict(QUERIES)
