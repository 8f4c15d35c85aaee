"""Registered queries over the test tables, each with its DuckDB SQL where it has one."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("text_queries", "corpus_queries", "feature_queries", "scoring_queries", "model_queries", "graph_queries")

QUERIES: dict = {}
ORACLE: dict = {}
for _name in _MODULES:
    _module = import_module(f"corpuslab.catalog.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
