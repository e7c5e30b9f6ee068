"""All queries of the reference's operators."""

from __future__ import annotations

from gridlore.plans import blocks, detection, extras, files, formats, outlines, rasters, spatial, stats

MODULES = [detection, stats, spatial, rasters, formats, extras, files, outlines, blocks]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.reg.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.reg.sql.items()}
