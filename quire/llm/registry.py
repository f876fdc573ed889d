"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from quire.llm import ann, audit, chat, extract, langid, mixing, packing, quality, secrets, sharding, simhash, sketches, tries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (langid, simhash, quality, sketches, ann, packing, chat, sharding, secrets, mixing, audit, extract, tries):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(getattr(_module, "ORACLE_SQL", {}))
