"""All registered queries; importing the modules fills the register."""

from __future__ import annotations

from . import (  # noqa: F401
    bundle_queries,
    model_queries,
    patch_queries,
    pixel_queries,
    score_queries,
    store_queries,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
