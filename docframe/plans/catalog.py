"""Queries by name, and the DuckDB SQL of each that SQL can express."""

from __future__ import annotations

from docframe.plans import analytics, documents, more, operations, payloads, runs, tools

QUERIES = analytics.QUERIES | documents.QUERIES | operations.QUERIES | more.QUERIES | payloads.QUERIES | runs.QUERIES | tools.QUERIES
ORACLES = analytics.ORACLES | documents.ORACLES | operations.ORACLES | more.ORACLES | payloads.ORACLES | runs.ORACLES | tools.ORACLES
