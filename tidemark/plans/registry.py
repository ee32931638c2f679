"""Registered queries and their SQL twins."""

from __future__ import annotations

from tidemark.plans import intake, live, more, relational, telemetry, text

_MODULES = [telemetry, relational, text, live, more, intake]

QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
