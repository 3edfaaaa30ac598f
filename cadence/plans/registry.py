"""All registered driver queries and their DuckDB oracles, gathered by family."""

from __future__ import annotations

import importlib

FAMILIES = ("q_words", "q_text", "q_keys", "q_evaluate", "q_syntax", "q_models", "q_signal", "q_stream")


def _load():
    queries, oracles = {}, {}
    for fam in FAMILIES:
        m = importlib.import_module(f"cadence.plans.{fam}")
        queries.update(m.QUERIES)
        oracles.update(m.ORACLES)
    return queries, oracles


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
