"""All registered queries of the engine."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

for _name in (
    "functions.queries",
    "sources.queries",
    "operators.money",
    "operators.patterns",
    "operators.temporal",
    "operators.risk",
    "operators.graph",
    "operators.relational",
    "operators.extract",
    "operators.evidence",
    "operators.retrieval",
    "operators.scoring",
    "operators.ledgers",
    "operators.messages",
    "operators.tables",
    "operators.classification",
    "operators.planning",
    "operators.gazetteer",
    "operators.linking",
    "operators.wiring",
    "operators.casework",
    "functions.display",
    "sources.files",
):
    import_module(f"tracewell.{_name}")

__all__ = ["ORACLES", "QUERIES"]
