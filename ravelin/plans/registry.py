"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from ravelin.plans import algebra, base, dataflow, evaluation, execution, joins, more, participants, readers, retrieval, scores, texts, variants  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
