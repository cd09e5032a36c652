"""All registered queries of the event analytics, and their DuckDB SQL."""

from tremor.queries import alarms, audits, cascades, feeds, graph, ingest, models, reports, state, streams  # noqa: F401
from tremor.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
