"""Every query of the interval and sequence library with its SQL, by name."""

from __future__ import annotations

from .plans import analysis, corpus, features, formats, matching, motifs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (corpus, features, formats, matching, analysis, motifs):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.SQL
