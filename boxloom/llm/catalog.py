"""Every query of this subpackage by name, with the SQL that checks it."""

from __future__ import annotations

from boxloom.llm import abuse, bpe, leaks, overlap, percentiles, pieces, related, topn

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in (pieces, related, topn, percentiles, overlap, bpe, leaks, abuse):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
