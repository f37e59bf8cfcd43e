"""All named queries of the library."""

from __future__ import annotations

from . import dialogue, exports, items, loops, media, scoring
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "dialogue", "exports", "items", "loops", "media", "scoring"]
