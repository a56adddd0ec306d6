"""All queries of the library and the SQL that states their results."""

from __future__ import annotations

from framewise.plans import answers, dataset, extras, retrieval, timeline, trajectory  # noqa: F401
from framewise.plans.views import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
