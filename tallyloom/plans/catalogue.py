"""Every query of the engine with its DuckDB SQL."""

from __future__ import annotations

from . import contrasts, corpus, evaluation, facts, landed, learners, ledger, measurement, prepare, replay, runs, screening, sourcerules, spans, textual  # noqa: F401  they register on import
from .registry import IDS, ORACLE_SQL, QUERIES

__all__ = ["IDS", "ORACLE_SQL", "QUERIES"]
