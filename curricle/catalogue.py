"""All queries of the engine and their SQL counterparts by name."""

from __future__ import annotations

from .queries import people, records, texts

QUERIES = people.QUERIES | texts.QUERIES | records.QUERIES
ORACLES = people.ORACLES | texts.ORACLES | records.ORACLES
