"""All queries of the library's own operators, by name, and their DuckDB forms."""

from __future__ import annotations

from importlib import import_module

MODULES = ["vocabulary", "retrieval", "language", "documents", "labels", "answers", "models", "annotated"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"tesela.plans.{_name}")
    if _twice := QUERIES.keys() & _module.QUERIES.keys():
        raise ValueError(f"queries registered twice: {sorted(_twice)}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
