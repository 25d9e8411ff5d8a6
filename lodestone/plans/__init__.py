"""Every registered query of the engine and its SQL."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES, Query

FLAGSHIP = "hybrid_search"
MODULES = ["text_plans", "search_plans", "memory_plans", "history_plans", "code_plans"]


def _load() -> None:
    for m in MODULES:
        import_module(f"{__name__}.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
