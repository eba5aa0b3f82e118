"""Registered queries of the linkage engine over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from . import keys, linkage, listings, stored, tables

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (keys, linkage, tables, listings, stored):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
