"""Every query of the engine by name, and its SQL where SQL can express it."""

from loomery.plans import benchmarks, curation, enrichment, facts, reports, rows, steps, storage, trees  # noqa: F401
from loomery.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
