"""All queries of the library by name, and SQL that gives the same rows."""

from __future__ import annotations

from .queries import measures, text_rules, timeline
from .queries.base import ORACLE_SQL, QUERIES

FLAGSHIP = measures.flagship_wer.__name__
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "measures", "text_rules", "timeline"]
