"""Registered queries. Importing the query modules fills the registry."""

from __future__ import annotations

import importlib

MODULES = ("text_queries", "graph_queries", "run_queries", "score_queries", "corpus_queries", "code_queries", "check_queries", "log_queries", "stream_queries", "more_queries", "report_queries")


def load_queries():
    from datarights.plans import registry

    for name in MODULES:
        importlib.import_module(f"datarights.plans.{name}")
    return registry.QUERIES, registry.ORACLES
