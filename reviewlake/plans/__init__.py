"""Queries on the driver's tables, one per operator or small group of them."""

from reviewlake.plans import (  # noqa: F401
    agreement,
    assistant,
    exports,
    graph,
    pages,
    resolution,
    search,
    stored,
    values,
    workbooks,
    workload,
)
from reviewlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
