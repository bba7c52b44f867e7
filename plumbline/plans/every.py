"""All queries and their SQL."""

from plumbline.plans import workflow  # noqa: F401  adds its queries
from plumbline.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
