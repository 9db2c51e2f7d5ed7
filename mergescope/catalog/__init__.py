"""Registered queries over the provided tables, each with its checking SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

AREAS = ["texts", "pulls", "preparation", "evaluation", "balancing", "storage", "modelling"]


def load() -> dict:
    from .registry import ENTRIES

    for area in AREAS:
        import_module(f"{__name__}.{area}")
    return dict(ENTRIES)
