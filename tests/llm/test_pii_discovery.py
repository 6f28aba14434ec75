"""What bootstrapped patterns find that the base patterns miss, and what they leave alone."""

from __future__ import annotations

import random

from factloom.llm import pii
from tests.llm.helpers import sentence

#: A context for each kind, seeds that the base patterns find in it, and identifiers of formats that they don't know.
CONTEXTS = [
    ("you can write to us at address: {} every day", lambda r: f"user{r.randint(1, 9999)}@mail{r.randint(1, 99)}.com", lambda r: f"user{r.randint(1000, 9999)}@intern"),
    ("the request came from host address {} this morning", lambda r: ".".join(str(r.randint(1, 255)) for _ in range(4)), lambda r: f"fe80:0:{r.randint(1, 999)}::{r.randint(1, 99)}"),
    ("the customer pays with card number {} as before", lambda r: card(r), lambda r: f"CARD-{r.randint(10**7, 10**8)}-X"),
    ("please ring the office under telephone {} after noon", lambda r: f"+49 {r.randint(100, 999)} {r.randint(10000, 99999)}", lambda r: f"0{r.randint(100, 999)}/{r.randint(10**5, 10**6)}"),
]


def card(r):
    digits = [r.randint(0, 9) for _ in range(15)]
    last = next(d for d in range(10) if pii.luhn("".join(map(str, [*digits, d]))))
    return "".join(map(str, [*digits, last]))


def corpus(seeds, unseen, noise, seed=3):
    """Rows, and the (doc_id, kind, start, stop) of the planted identifiers that base patterns miss."""
    r = random.Random(seed)
    rows, planted = [], set()
    for kind, (context, known, unknown) in enumerate(CONTEXTS):
        for k in range(seeds + unseen):
            value = known(r) if k < seeds else unknown(r)
            lead = sentence(r, "en", r.randint(0, 5))
            text = f"{lead} {context.format(value)} {sentence(r, 'en', 4)}".strip()
            if k >= seeds:
                at = text.index(value)
                planted.add((len(rows), kind, at, at + len(value)))
            rows.append((len(rows), text))
    for _ in range(noise):  # numbers and marks among plain words
        value = r.choice([f"{r.randint(1000, 99999)}", f"v{r.randint(1, 9)}.{r.randint(1000, 9999)}", f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-11", "a@b"])
        rows.append((len(rows), f"{sentence(r, 'en', 5)} {value} {sentence(r, 'en', 5)}"))
    r.shuffle(rows)
    return rows, planted


def added(spark, rows):
    found = pii.personal_data(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return {(r.doc_id, s.kind, s.start, s.stop) for r in found for s in r.added}


def test_recall_and_precision(spark):
    rows, planted = corpus(40, 15, 200)
    got = added(spark, rows)
    assert len(got & planted) / len(planted) >= 0.95
    assert len(got & planted) / len(got) >= 0.95


def test_as_many_unseen_as_seeds(spark):
    rows, planted = corpus(30, 30, 50)
    assert len(added(spark, rows) & planted) / len(planted) >= 0.95


def test_few_seeds_find_nothing(spark):
    rows, _ = corpus(3, 10, 20)
    assert not added(spark, rows)


def test_start_of_a_text(spark):
    rows = [(i, f"Telephone: +1 555 000 {1000 + i}") for i in range(8)] + [(50, "Telephone: 0555/123456")]
    assert added(spark, rows) == {(50, 3, 11, 22)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(spark, none).count() == 0
