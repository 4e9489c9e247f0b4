"""A small registry of named queries and their check SQL."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries = {}
        self.sql = {}

    def __call__(self, name: str, sql: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register
