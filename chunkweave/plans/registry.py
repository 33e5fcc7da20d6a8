"""All registered queries with the SQL they are checked against."""

from __future__ import annotations

from chunkweave.plans import build_checks, catalogue_checks, chunk_checks, enrich_checks, packet_checks, search_checks

MODULES = (build_checks, search_checks, chunk_checks, enrich_checks, catalogue_checks, packet_checks)


def registered() -> dict:
    found: dict = {}
    for module in MODULES:
        for name, entry in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} registered twice")
            found[name] = entry
    return found
