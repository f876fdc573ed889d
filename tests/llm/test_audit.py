"""Filter audits against walking every order over every document."""

import itertools
import random
import re
from fractions import Fraction
from math import factorial

import pytest
from pyspark.sql import functions as F

from quire.llm import audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def plain_fails(rows):
    """The failed filters of each row, by their definitions."""
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [other[0] for other in rows if (other[1] or "") == text and other[0] is not None]
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if doc_id is not None and any(other < doc_id for other in same) else set()
        out.append(fails)
    return out


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = {}
    for row, fails in zip(rows, plain_fails(rows), strict=True):
        parts.setdefault(row[3] or "", []).append((row[0], fails))
    out = {}
    for part, docs in parts.items():
        whole = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(docs)
            for step, letter in enumerate(order, 1):
                here = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                whole[letter] += len(here)
                failing = [d for d in docs if letter in d[1]]
                out[part, "".join(order), step] = [
                    len(left), len(here), len(failing) - len(here), sum(d[1] == {letter} for d in docs), sum(d[0] in good for d in here), sum(d[0] in toxic for d in here)
                ]
        for (name, order, step), row in out.items():
            if name == part:
                row.append(whole[order[step - 1]])
    return out


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def run(spark, rows, labels, odd_columns=False):
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    if odd_columns:
        docs = docs.select("*", *[F.lit(7).alias(c) for c in ("part", "mask", "n", "digest", "good", "toxic", "low")])
        marks = marks.select("*", F.lit(7).alias("n"), F.lit("x").alias("part"))
    return audit.orders(audit.polynomials(audit.masks(docs, marks), 5))


def test_odd_rows(spark):
    many = " ".join(f"w{k}" for k in range(250))
    rows = [
        (1, None, None, None, 0), (2, "", "en", "a", 0), (3, "", "en", None, 0), (3, "", "en", None, 0), (None, "", "en", "a", 0), (None, "", "en", "b", 0),
        (4, many, "en", "a", 9), (5, many, "en", "b", 9), (5, many, "en", "a", 9), (6, many + " #", "en", "a", 9), (7, "SHOUT " * 300, "en", "b", 9), (8, "word " * 300, "en", "", 9),
        (-1, many, "en", "b", 9), (9, "A1 \t\x0b x y z \x1c", "en", "b", 9), (10, "ß" * 50 + "A", "de", "b", 9), (11, many * 400, "en", "b", 9), (12, many * 400, "en", "c", 9),
    ]
    labels = [(3, 1, 0), (3, 0, 1), (5, None, 1), (None, 1, 1), (7, 1, 1), (99, 1, 1), (12, 1, 0)]
    assert found(run(spark, rows, labels, odd_columns=True)) == plain_audit(rows, labels)


def test_random_rows(spark):
    rng = random.Random(5)
    words = ["a", "b", "C", "d#", "EE", "f"]
    rows = [(k if rng.random() < 0.95 else None, " ".join(rng.choices(words[: rng.randint(1, 6)], k=rng.choice([1, 2, 3, 240]))), "en", rng.choice(["x", "y", None, ""]), 0) for k in range(400)]
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 400, 3)]
    assert found(run(spark, rows, labels)) == plain_audit(rows, labels)


def test_empty(spark):
    assert run(spark, [], []).collect() == []
    assert found(run(spark, [(1, "x", "en", "a", 1)], []))["a", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


@pytest.mark.parametrize("filters", [1, 2, 3, 5])
def test_polynomial(filters):
    rng = random.Random(filters)
    counts = [rng.randint(0, 50) for _ in range(1 << filters)]
    polynomial = audit.removal_polynomial(counts)
    values = audit.corners(polynomial)
    for chosen in range(1 << filters):
        assert values[chosen] == sum(n for mask, n in enumerate(counts) if mask & chosen)
        assert values[chosen] == sum(c for some, c in enumerate(polynomial) if some & chosen == some)
    for which in range(filters):
        total = 0
        for order in itertools.permutations(range(filters)):
            before = sum(1 << k for k in order[: order.index(which)])
            total += values[before | 1 << which] - values[before]
        assert audit.shapley(polynomial, which) == Fraction(total, factorial(filters))


def test_a_text_of_a_third_of_all_rows_is_folded(spark):
    """What meets in one group of a digest is a row for each part and labels, whatever the number of copies."""
    rows = [(k, "same text" if k % 3 else f"text {k}", "en", f"s{k % 4}", 0) for k in range(3000)]
    assert found(run(spark, rows, [])) == plain_audit_by_counts(rows)


def plain_audit_by_counts(rows):
    least = {}
    for doc_id, text, *_ in rows:
        least[text] = min(doc_id, least.get(text, doc_id))
    fails = {"A"}, {"A", "E"}
    out = {}
    for part in {r[3] for r in rows}:
        docs = [fails[r[0] > least[r[1]]] for r in rows if r[3] == part]
        n, copies = len(docs), sum("E" in d for d in docs)
        for order in itertools.permutations("ABCDE"):
            kept = n
            for step, letter in enumerate(order, 1):
                first = order.index("A") < order.index("E")
                removed = {"A": n if first else n - copies, "E": 0 if first else copies}.get(letter, 0)
                kept -= removed
                failing = {"A": n, "E": copies}.get(letter, 0)
                whole = {"A": 60 * n + 60 * (n - copies), "E": 60 * copies}.get(letter, 0)
                out[part, "".join(order), step] = [kept, removed, failing - removed, n - copies if letter == "A" else 0, 0, 0, whole]
    return out
