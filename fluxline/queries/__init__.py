"""Queries over the driver tables, grouped by subject."""

from __future__ import annotations

from importlib import import_module

SUBJECTS = ("temporal", "quality", "labels", "operations", "audit", "drivers", "streams", "upkeep", "reading")


def load():
    """The registry with every subject loaded."""
    for subject in SUBJECTS:
        import_module(f"fluxline.queries.{subject}")
    return import_module("fluxline.queries.catalog")
