"""End-to-end plans and the query registry used by ``__spark_entry__``."""

from __future__ import annotations

import importlib

_MODULES = ("q_fx", "q_ts", "q_news", "q_panel", "q_sources")


def all_queries():
    from .catalog import REGISTRY

    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return dict(REGISTRY)
