"""All registered queries of the library."""

from tidemark.plans import accounting, analytics, cdc, filters, streams  # noqa: F401  importing registers
from tidemark.plans.registry import QUERIES, SQL  # noqa: F401
