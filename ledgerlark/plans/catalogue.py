"""All queries of the library; importing a plan module registers its queries."""

from __future__ import annotations

from . import facts, filings, retrieval, texts
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "facts", "filings", "retrieval", "texts"]
