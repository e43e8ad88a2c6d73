"""Registry of the pricing engine's queries and their SQL oracles."""

from __future__ import annotations

from marketloom.plans import listings, pages, relations, scalars, searches, statistics

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (statistics, scalars, relations, pages, listings, searches):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
