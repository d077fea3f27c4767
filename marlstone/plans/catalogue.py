"""All named queries of the library and their SQL."""

from __future__ import annotations

from marlstone.plans import arguments, audits, binding, bundles, evaluation, graphs, joins, loaders, ranking, readings, records, reports, retrieval, streams, texts, vectors  # noqa: F401  registers
from marlstone.plans.registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
