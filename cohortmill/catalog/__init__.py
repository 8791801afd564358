"""All registered queries."""

from cohortmill.catalog import (  # noqa: F401
    concepts,
    events,
    learning,
    mentions,
    notes,
    scalars,
    studies,
    tables,
    verdicts,
)
from cohortmill.catalog.base import REGISTRY, runnable

__all__ = ["REGISTRY", "runnable"]
