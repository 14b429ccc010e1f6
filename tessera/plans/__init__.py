"""Registered queries of the library's own operators, by area."""

from __future__ import annotations

from tessera.plans import details, discovered, flows, indexes, ingestion, pages, ranking, retrieval, scalars, sources, synchronisation

_AREAS = (retrieval, indexes, discovered, scalars, ingestion, synchronisation, pages, flows, sources, ranking, details)


def queries() -> dict:
    return {name: f for area in _AREAS for name, f in area.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for area in _AREAS for name, sql in area.ORACLES.items()}
