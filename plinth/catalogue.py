"""All registered queries outside the optional subpackage, with their oracle SQL."""

from __future__ import annotations

from plinth.plans import curating, entities, retrieving, series, streams  # noqa: F401  they register on import
from plinth.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
