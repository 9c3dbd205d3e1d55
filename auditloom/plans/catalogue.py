"""All named queries outside the optional subpackages."""

from __future__ import annotations

from auditloom.plans import audits, comparisons, inventory2, problems

_MODULES = [comparisons, audits, inventory2, problems]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
