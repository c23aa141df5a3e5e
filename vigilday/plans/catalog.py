"""All queries, collected from their modules."""

from vigilday.plans import chain, data, evaluation, scoring, search, streams  # noqa: F401
from vigilday.plans.registry import QUERIES, SQL  # noqa: F401
