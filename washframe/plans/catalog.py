"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from washframe.plans import (queries_cleaning, queries_edge, queries_io, queries_profile,  # noqa: F401
                             queries_transforms)
from washframe.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
