"""The table of registered queries."""

from __future__ import annotations

from contextvars import ContextVar
from functools import wraps

from tremor.sources.shared import saved

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_tables: ContextVar = ContextVar("tables of the running query", default=None)


def query(sql: str | None = None):
    def wrap(f):
        @wraps(f)
        def run(spark, sf_dir):
            if _tables.get() is not None:  # called by another query
                return f(spark, sf_dir)
            token = _tables.set({})
            try:
                return f(spark, sf_dir)
            finally:
                _tables.reset(token)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return wrap


def once(f):
    """A table that a query reads several times, such as its bars or episodes: made and written once in each run of a query."""

    @wraps(f)
    def table(spark, sf_dir):
        made = _tables.get()
        if made is None:
            return f(spark, sf_dir)
        if (f, sf_dir) not in made:
            made[f, sf_dir] = saved(f(spark, sf_dir))
        return made[f, sf_dir]

    return table
