"""All registered queries and their SQL."""

from tallywright.plans import batch_queries, screen_queries  # noqa: F401  (they register their queries)
from tallywright.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
