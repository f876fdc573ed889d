"""Secret scans: keyword automaton, anchored expressions near hits, checksums.

One pass of an Aho-Corasick automaton over the case-folded text finds keyword
hits; a regular expression is then anchored at each hit only. Kinds that have an
embedded checksum are kept only when it holds.

Kinds, in the order that breaks ties between spans with the same start:

========  =====================================================================
assign    ``password=...`` and the like, value of 6 or more characters
access    ``AKIA...``, 20 or more characters
hex       runs of 24 or more lower-case hexadecimal digits (no keyword exists
          for these, so they are found by their own bounded expression)
checked   ``ghp_``/``gho_``/``ghu_``/``ghs_``/``ghr_``/``npm_`` tokens whose last
          six characters are the base-62 CRC-32 of the thirty before them
jwt       three base64url parts whose first decodes to a JSON object with "alg"
========  =====================================================================

Defined results: a null text counts as empty and has no span; empty tables give
empty results; repeated rows are scanned each for itself; offsets are in code
points, end exclusive; texts are scanned whole, whatever their length, in time
that is proportional to it; columns
other than id and text are ignored (``scan``) or passed through (``redact``).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices, table

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "checked", "jwt")
_ORDER = {kind: k for k, kind in enumerate(KINDS)}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

# The keywords and expressions of the contract.
_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "jwt": ("eyj",),
}
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CHECKED = re.compile(r"(gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_BASE64_RUN = re.compile(r"[A-Za-z0-9_-]+")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum62(body: str) -> str:
    """CRC-32 of the text in base 62, padded to six digits."""
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, rest = divmod(value, 62)
        digits = _BASE62[rest] + digits
    return digits.rjust(6, "0")


def _signed_header(part: str) -> bool:
    try:
        header = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


_RULES = {
    "assign": (_ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (_ACCESS, lambda m: len(m[0]) >= 20),
    "checked": (_CHECKED, lambda m: checksum62(m[2]) == m[3]),
    "jwt": (_JWT, lambda m: _signed_header(m[1])),
}


def spans(text: str | None, automaton: ahocorasick.Automaton | None = None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text, by start, then kind."""
    if not text:
        return []
    automaton = automaton or _automaton()
    # bytes.lower() folds A-Z alone, so offsets keep their places
    folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = sorted((end - size + 1, kind) for end, (kind, size) in automaton.iter(folded))
    found, free = [], dict.fromkeys(_RULES, 0)
    for start, kind in hits:
        if start < free[kind]:
            continue  # inside the match before it
        expression, holds = _RULES[kind]
        if match := expression.match(text, start):
            free[kind] = match.end()
            if holds(match):
                found.append((kind, start, match.end()))
            elif kind == "jwt":
                free[kind] = match.end(1)  # a token may begin in the parts behind
        elif kind == "jwt" and text.startswith("eyJ", start):
            # what follows the run fails every other hit inside it too, so a run is read once
            free[kind] = _BASE64_RUN.match(text, start).end()
    found += [("hex", *match.span()) for match in _HEX.finditer(text)]
    found.sort(key=lambda span: (span[1], _ORDER[span[0]]))
    return found


def join_spans(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, spans array<struct<kind,start,end>>) of every row, in one pass without a shuffle."""
    kind = docs.schema[id_column].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for text in batch.column(1):
                rows.append([{"kind": k, "start": s, "end": e} for k, s, e in spans(text.as_py(), automaton)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, shape)], ["id", "spans"])

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        find, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    ).withColumnRenamed("id", id_column)


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span (overlaps joined) replaced by ``mark``."""
    schema, at = docs.schema, docs.columns.index(text_column)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in (some for whole in batches for some in slices(whole, at)):
            texts = batch.column(at)
            out = []
            for value in texts:
                text = value.as_py()
                if found := spans(text, automaton):
                    pieces, done = [], 0
                    for _, start, end in found:
                        if start >= done:
                            pieces += [text[done:start], mark]
                        done = max(done, end)
                    text = "".join(pieces) + text[done:]
                out.append(text)
            columns = [*batch.columns]
            columns[at] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(clean, schema)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Spans of every document with counts and a digest of the base kinds."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    line = lambda some: F.array_join(
        F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


def digest(found: list[tuple[str, int, int]]) -> str:
    """The digest of the query, for tests."""
    return hashlib.sha256(join_spans([s for s in found if s[0] in BASE_KINDS]).encode()).hexdigest()


QUERIES = {"op9_secrets": op9_secrets}
