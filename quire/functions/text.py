"""Text expressions: tokens, snippets, screens and small grammars.

Everything here is a Column expression that stays inside generated code.
Patterns are kept to what both Java and RE2 read alike, so the same pattern
serves the SQL that checks a query.
"""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token shapes, stop words, units and screening patterns.
LIBRARY_TOKEN = r"[\p{L}\p{N}_]+"
SITE_TOKEN = r"\d+\.\d+[a-z]*|[a-z0-9][a-z0-9\-']{2,}"
STOP_WORDS = (
    "a an and are as at be but by for from has have how in into is it its of on or that the their there these this to was "
    "were what when where which who will with your you if not no all any can may each other some such than then they them "
    "we our us do does did be been being about after before over under more most only same so too very just also"
).split()
EXCLUSION = r"(?i)\b(?:except|excluding|not\s+for|does\s+not\s+apply\s+to)\b"
EVIDENCE = (
    r"(?i)\b(?:19|20)\d{2}\b|\b\d\.\d\s*(?:L\b|liter)|\bonly\b|\bexcept\b|"
    r"\b(?:diesel|gasoline|VIN|RPO|Silverado|Sierra|Chevrolet|GMC)\b"
)
MEDIA_TYPES = {
    "html": "text/html",
    "htm": "text/html",
    "pdf": "application/pdf",
    "svg": "image/svg+xml",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "xml": "text/xml",
    "json": "application/json",
    "txt": "text/plain",
    "css": "text/css",
}
UNITS = {
    "Hz": ("frequency", "Hz"),
    "G/S": ("mass flow", "g/s"),
    "V": ("voltage", "V"),
    "DCV": ("voltage", "V"),
    "N.m": ("torque", "N.m"),
    "Nm": ("torque", "N.m"),
    "N·m": ("torque", "N.m"),
    "lb-ft": ("torque", "lb-ft"),
    "mm": ("length", "mm"),
    "in": ("length", "in"),
}
NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"
LITRE_QUANTITY = r"(\d{1,2}(?:\.\d+)?|\.\d+)\s*(?:l\b|liter\b|litre\b)"
OIL_COMPARISON = r"\boil consumption(?: rate)?\s+(?:is\s+)?(?:not\s+)?(?:higher|greater|more|less|lower)\s+than\s+"
QUART_EQUIVALENT = r"\s*\(\s*\d+(?:\.\d+)?\s+(?:quarts?|qt)\s*\)"

# The white space that ends a word, as both Java and RE2 write it.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# A quantity doesn't begin inside a word or a decimal; RE2 has no look-behind, so what is before it is read too.
LITRES = r"(?:^|[^\p{L}\p{N}_.,])" + LITRE_QUANTITY
OIL_RATE = OIL_COMPARISON + LITRE_QUANTITY.replace("(", "(?:", 1) + QUART_EQUIVALENT
# Names that this engine's own extracts give their records.
RESERVED_PATHS = (".quire-manifest.json", ".quire-inventory.json")


@functools.cache
def _folds() -> tuple[str, dict[str, str]]:
    """Characters whose full case folding isn't their lower case, and what the lower-case ones among them become.

    By the rule of Unicode, for every code point, so there is no table to keep.
    """
    every = [chr(k) for k in range(sys.maxunicode + 1) if not 0xD800 <= k < 0xE000]
    becomes = {c: c.casefold() for c in every if c.casefold() != c and c.lower() == c}
    # a capital sigma's lower case depends on what follows, and some capitals are several letters
    odd = [c for c in every if c.casefold() != c.lower() or len(c.lower()) > 1 or c.casefold() == "\u03c3"]
    runs: list[list[int]] = []
    for k in map(ord, odd):
        if runs and k == runs[-1][1] + 1:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    # ASCII is ruled out first, so most characters meet one test
    return r"[\x{80}-\x{10ffff}&&[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]]", becomes


def casefold(text: Column) -> Column:
    """Full case folding: texts that differ in case only become the same, ``Straße`` and ``STRASSE`` too."""
    odd, becomes = _folds()
    low = F.lower(text)
    single = {c: to for c, to in becomes.items() if len(to) == 1}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(to).alias("to")) for c, to in becomes.items() if len(to) > 1])
    one = F.translate(low, "".join(single), "".join(single.values()))
    return F.when(text.rlike(odd), F.aggregate(pairs, one, lambda done, pair: F.replace(done, pair["c"], pair["to"]))).otherwise(low)


def library_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, case-folded."""
    plain = F.regexp_extract_all(F.lower(text), F.lit(LIBRARY_TOKEN), F.lit(0))
    # where folding is more than lower case it may add marks, so words are found before
    words = F.array_join(F.regexp_extract_all(text, F.lit(LIBRARY_TOKEN), F.lit(0)), " ")
    return F.when(text.rlike(_folds()[0]), F.filter(F.split(casefold(words), " "), lambda word: word != "")).otherwise(plain)


def site_tokens(text: Column) -> Column:
    """Words of three characters or more; decimal quantities such as 5.0l stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(SITE_TOKEN), F.lit(0))


def indexed_tokens(text: Column) -> Column:
    """Site tokens without stop words."""
    return F.filter(site_tokens(text), lambda t: ~t.isin(STOP_WORDS))


def compact(text: Column) -> Column:
    """White space runs, those of Unicode too, become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def snippet(text: Column, terms: list[str], before: int = 60, after: int = 160) -> Column:
    """The text around the first place where any of the terms stands, as a substring."""
    folded = casefold(text)
    places = [F.nullif(F.locate(t, folded), F.lit(0)) for t in terms]
    first = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1)) - 1
    start = F.greatest(first - before, F.lit(0))
    return F.substring(text, start + 1, first + after - start)


def phrase_pattern(phrase: str) -> str:
    """A pattern for the literal phrase between word ends, blanks of any width."""
    words = ["".join(c if c.isalnum() or c == "_" else "\\" + c for c in w) for w in phrase.split()]
    return r"(?i)(?:^|[^\p{L}\p{N}_])" + r"\s+".join(words) + r"(?:$|[^\p{L}\p{N}_])"


def identifiers(text: Column) -> Column:
    """Part identifiers: four or more capitals or digits, a hyphen, three or more of these or hyphens.

    A run of such characters is looked at once, from its last place that can
    begin one, so no look-around is needed.
    """
    runs = F.regexp_extract_all(F.upper(text), F.lit("[A-Z0-9-]+"), F.lit(0))
    found = F.transform(runs, lambda r: F.regexp_extract(r, "(?:^|-)([A-Z0-9]{4,}-[A-Z0-9-]{3,})$", 1))
    return F.array_distinct(F.filter(found, lambda r: r != ""))


def litre_quantities(text: Column) -> Column:
    """Distinct quantities in litres; a rate of oil consumption with its quarts is left out."""
    bare = F.regexp_replace(F.lower(text), OIL_RATE, " ")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(LITRES), F.lit(1)))


def model_years(text: Column, bounded: Column | bool = True) -> Column:
    """struct(state, value, start, end): a range of model years, a single one, or unknown.

    Years count where something else of the text is known (``bounded``), or where
    it speaks of model years itself.
    """
    year = r"((?:19|20)[0-9]{2})"
    span = rf"\b{year}\s*[-–—]\s*{year}\b"
    first, last = F.regexp_extract(text, span, 1), F.regexp_extract(text, span, 2)
    alone = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b{year}\b"), F.lit(1)))
    counts = (F.lit(bounded) if isinstance(bounded, bool) else bounded) | text.rlike(r"(?i)\bmodel\s+years?\b")
    state = (
        F.when(~counts, F.lit("unknown"))
        .when((first != "") & (first <= last), F.lit("range"))
        .when(F.size(alone) == 1, F.lit("exact"))
        .otherwise(F.lit("unknown"))
    )
    return F.struct(
        state.alias("state"),
        F.when(state == "exact", F.try_element_at(alone, F.lit(1)).cast("int")).alias("value"),
        F.when(state == "range", first.try_cast("int")).alias("start"),
        F.when(state == "range", last.try_cast("int")).alias("end"),
    )


NUMERIC = rf"^{BLANK}*({NUMBER})(?:\s*(?:-|to)\s*({NUMBER}))?{BLANK}*$"


def numeric_range(raw: Column, unit: Column) -> Column:
    """struct(minimum, maximum, unit) of a number or a range whose column names a known unit, else null.

    Nothing is repaired or converted, and no unit is guessed: the unit is that of
    the column, spelt as in ``UNITS``.
    """
    known = F.create_map(*[F.lit(x) for name, (_, shown) in UNITS.items() for x in (name, shown)])
    low, high = F.regexp_extract(raw, NUMERIC, 1), F.regexp_extract(raw, NUMERIC, 2)
    least, most = low.try_cast("double"), F.when(high == "", low).otherwise(high).try_cast("double")
    name = F.try_element_at(known, unit)
    fine = raw.rlike(NUMERIC) & name.isNotNull() & (least <= most) & (F.abs(least) < float("inf")) & (F.abs(most) < float("inf"))
    return F.when(fine, F.struct(least.alias("minimum"), most.alias("maximum"), name.alias("unit")))


def media_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(known, extension), F.lit("application/octet-stream"))


def _first(reasons: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds, or null."""
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in reasons])


def unsafe_path(path: Column, folder: bool = False) -> Column:
    """The first reason why a member's path isn't safe to write, or null; a folder may end in a slash."""
    name = F.regexp_replace(path, "/$", "") if folder else path
    return _first(
        [
            ("empty", F.coalesce(path == "", F.lit(True))),
            ("NUL character", path.contains("\0")),
            ("backslash", path.contains("\\")),
            ("root", name == ""),
            ("absolute", name.rlike("^(/|[A-Za-z]:)")),
            ("not canonical", name.rlike(r"(^|/)\.{0,2}(/|$)")),
            ("control character", name.rlike(r"[\x01-\x1f]")),
            ("reserved", F.lower(name).isin(*RESERVED_PATHS)),
        ]
    )


def path_problem(path: Column) -> Column:
    """Why a path has no portable spelling below its source, or null."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return _first(
        [
            ("empty", F.coalesce(path == "", F.lit(True))),
            ("NUL character", path.contains("\0")),
            ("absolute", slashed.rlike("^(/|[A-Za-z]:)")),
            ("leaves the source", slashed.rlike(r"(^|/)\.\.(/|$)")),
            ("control character", slashed.rlike(r"[\x01-\x1f]")),
            ("root", ~slashed.rlike(r"(^|/)(\.[^/]|[^./])")),
        ]
    )


def canonical_path(path: Column) -> Column:
    """The path with slashes, without empty and ``.`` parts; null where ``path_problem`` names a reason."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    return F.when(path_problem(path).isNull(), F.array_join(parts, "/"))
