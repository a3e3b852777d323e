"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from .plans import alignment, answers, bands, codes, detections, extensions, geometry, grid, layout, reports, results, shapes, streams

FAMILIES = (answers, geometry, layout, codes, detections, results, reports, streams, shapes, alignment, bands, extensions, grid)


def queries() -> dict:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
