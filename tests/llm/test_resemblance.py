"""Near-duplicates at 0.8 of five-word shingles against all pairs."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from factloom.llm import resemblance
from tests.conftest import SMALL
from tests.llm.helpers import DOCS, clashing, documents, frame


def brute_kept(rows):
    """The doc_ids that stay: the least of each group of all pairs at 0.8 or more."""
    found = []
    for doc, text, *_ in rows:
        w = (text or "").encode().lower().split()
        found.append((doc, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    root = list(range(len(found)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(found):
        for j, (_, b) in enumerate(found[:i]):
            if 10 * len(a & b) >= 8 * len(a | b) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(found):
        r = find(i)
        least[r] = min((x for x in (doc, least.get(r)) if x is not None), default=None)
    return sorted(map(repr, least.values()))


def edited(seed=5):
    """Families of texts with a few words changed: likeness around 0.8, chains, and a boilerplate that many texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    shared = [word() for _ in range(40)]
    rows = []
    for family in range(12):
        text = (shared if family % 2 else []) + [word() for _ in range(rng.choice([8, 30, 100]))]
        for _ in range(12):
            text = list(text) if rng.random() < 0.5 else text
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
            rows.append((1000 + len(rows), " ".join(text), "en", "s", 1))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd, sample", [(64, 16), (3, 1)])
def test_groups_are_those_of_all_pairs(spark, crowd, sample):
    rows = documents() + edited()
    kept = resemblance.keep_one(spark, clashing(frame(spark, rows)), crowd, sample)
    assert kept.columns == clashing(frame(spark, rows)).columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == brute_kept(rows)
    assert resemblance.keep_one(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_stage_drops_what_is_alike_at_eight_tenths(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = sorted(repr(r.doc_id) for r in stage(spark, docs, SMALL).collect())
    assert kept == brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert "145" not in kept and "177" not in kept
