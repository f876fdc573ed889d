"""Content-addressed identifiers and digests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(kind: str, *parts: Column) -> Column:
    """``kind`` and the first 32 hex digits of the SHA-256 of kind and parts, joined by NUL."""
    joined = F.concat_ws("\0", F.lit(kind), *[p.cast("string") for p in parts])
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(joined, 256), 1, 32))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def ordered_digest(rows: Column) -> Column:
    """Digest of an array of structs that doesn't depend on the order of its items."""
    return F.sha2(F.to_json(F.sort_array(rows)), 256)


def canonical_json(value) -> str:
    """JSON with sorted keys, without blanks, letters outside ASCII kept; NaN and infinity are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()
