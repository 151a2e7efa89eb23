"""The registered queries of the engine, part by part."""

from __future__ import annotations

from ledgerloom.catalog import extras, ledgers, ownership, reading, scalars, searching, streams
from ledgerloom.catalog._registry import Query

PARTS = (reading, scalars, ledgers, ownership, streams, searching, extras)


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for part in PARTS:
        for name, q in part.REGISTRY.queries.items():
            if name in out:
                raise ValueError(f"{name} is registered twice")
            out[name] = q
    return out
