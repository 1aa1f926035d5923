"""Query name -> (callable, SQL). Callables take (spark, sf_dir)."""

from __future__ import annotations

from .views import Views, oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the views as a query, with its SQL twin."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE[name] = oracle(sql)
        return f

    return put


from . import cleaning, cohorts, episodes, scans, statistics, tracks  # noqa: E402, F401
