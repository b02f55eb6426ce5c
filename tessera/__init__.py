"""A PySpark engine for code-, log- and corpus-analysis work. Parts load on first use."""

from __future__ import annotations

import importlib

_PARTS = {
    "catalogue": "tessera.plans.catalogue", "registry": "tessera.plans.registry", "text": "tessera.functions.text", "steps": "tessera.streaming.steps", "files": "tessera.sources.files", "shared": "tessera.sources.shared",
} | {n: f"tessera.operators.{n}" for n in ("consensus", "eventlog", "graph", "hotspots", "logs", "metrics", "retrieval", "routing", "vector")}


def __getattr__(name: str):
    if name not in _PARTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return importlib.import_module(_PARTS[name])


def __dir__() -> list[str]:
    return sorted([*globals(), *_PARTS])
