"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

import importlib

_MODULES = [
    "quarry.plans.lexical",
    "quarry.plans.retrieval",
    "quarry.plans.cleaning",
    "quarry.plans.knowledge",
    "quarry.plans.answering",
    "quarry.plans.memory",
    "quarry.plans.sources",
    "quarry.plans.indexing",
    "quarry.plans.legacy",
    "quarry.plans.documents",
    "quarry.plans.inventory",
    "quarry.plans.streams",
]


def _mods():
    return [importlib.import_module(m) for m in _MODULES]


def all_queries():
    out = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def all_oracle_sql():
    out = {}
    for m in _mods():
        out.update(getattr(m, "ORACLE", {}))
    return out


def flagship(spark, sf):
    q = all_queries()
    name = "hybrid_top15" if "hybrid_top15" in q else "bm25_top5"
    return q[name](spark, sf)
