"""All registered queries."""

from cairnlens.plans import (  # noqa: F401
    integrity, live, metrics, nested, reports, search, sources, structure,
)
from cairnlens.plans.registry import QUERIES, run  # noqa: F401
