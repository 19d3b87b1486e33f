"""Registered queries and their SQL twins."""
from __future__ import annotations

from importlib import import_module

MODULES = ["channel_core", "snapshots", "dashboard", "insights", "decisions", "risk", "revenue", "text", "desk"]


def load():
    from .registry import REGISTRY
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return REGISTRY
