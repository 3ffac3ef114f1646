"""Named queries, one module per business area."""

from ledgerlane.plans import (  # noqa: F401
    accounts,
    campaigns,
    conversations,
    credit,
    dashboard,
    integrity,
    interactions,
    questions,
    streams,
)
from ledgerlane.plans.registry import QUERIES, run

__all__ = ["QUERIES", "run"]
