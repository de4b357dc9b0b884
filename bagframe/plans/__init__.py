"""Test tables derived from the driver tables, and the registered queries."""

from bagframe.plans import (  # noqa: F401  (importing registers the queries)
    queries_bags,
    queries_cohort,
    queries_geometry,
    queries_metrics,
    queries_sources,
    queries_splits,
    queries_survival,
)
from bagframe.plans.registry import ORACLE, QUERIES  # noqa: F401
