"""Registered queries: each applies a job to the driver's tables; SQL holds the same result in SQL."""

from noticejobs.plans import alerting, analytics, browse, documents, feeds, streams, texts  # noqa: F401
from noticejobs.plans.registry import QUERIES, SQL

FLAGSHIP = "j4_match_alerts"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
