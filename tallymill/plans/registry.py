"""Named queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, and its SQL if there is one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


from tallymill.plans import credit, detection, evaluation, medallion, retrieval, streams  # noqa: E402, F401
