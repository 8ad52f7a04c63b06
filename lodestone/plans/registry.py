"""All queries of the core, and their SQL."""

from __future__ import annotations

from lodestone.plans import curation, ingest, kb, manuscripts, orphans, retrieval, textual, tools
from lodestone.streaming import feedback

_MODULES = [retrieval, kb, textual, curation, tools, ingest, feedback, orphans, manuscripts]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
