"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import boxes, curation, detections, files, pixels, runs, similarity

MODULES = (curation, boxes, detections, similarity, runs, pixels, files)


def queries() -> dict:
    return {name: plan for m in MODULES for name, (plan, _) in m.PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.PLANS.items() if sql}
