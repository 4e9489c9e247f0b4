"""All registered queries."""

from __future__ import annotations

from . import (
    catalog_queries,
    payload_queries,
    published_queries,
    report_queries,
    run_queries,
    scalar_queries,
    search_queries,
    stream_queries,
    text_queries,
)

_MODULES = [
    catalog_queries,
    run_queries,
    search_queries,
    text_queries,
    payload_queries,
    published_queries,
    report_queries,
    scalar_queries,
    stream_queries,
]


def queries():
    found = {}
    for module in _MODULES:
        found.update({name: _in_utc(fn) for name, fn in module.query.queries.items()})
    return found


def oracle_sql():
    found = {}
    for module in _MODULES:
        found.update(module.query.sql)
    return found


def _in_utc(fn):
    """Dates in the tables have no zone and are UTC."""

    def run(spark, sf):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run
