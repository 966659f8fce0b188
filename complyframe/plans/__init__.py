"""Named queries over the test tables, each with the SQL it is checked against."""

from complyframe.plans import (  # noqa: F401  (importing registers the queries)
    aggregates,
    expressions,
    filters,
    joins,
    sources,
    state,
    streams,
    windows,
)
from complyframe.plans.registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
