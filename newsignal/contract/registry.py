"""All registered queries and their SQL."""

from __future__ import annotations

from newsignal.contract import ingest, records, reports, runs, texts

_PARTS = (reports, ingest, texts, records, runs)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
