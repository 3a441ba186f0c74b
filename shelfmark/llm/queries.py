"""All queries of this subpackage: name -> (query, SQL or None)."""

from __future__ import annotations

from shelfmark.llm import queries_free, queries_mined, queries_native

QUERIES = {**queries_native.QUERIES, **queries_free.QUERIES, **queries_mined.QUERIES}
