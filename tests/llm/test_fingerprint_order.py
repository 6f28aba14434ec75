"""The order of documents that fingerprints compare: one id on many rows, ties, nulls, few and many buckets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import fingerprints
from tests.llm.helpers import sentence


@pytest.mark.parametrize("buckets", [2, 7, 60])
def test_next_of_every_row(spark, buckets):
    rng = random.Random(buckets)
    ids = [7] * 150 + [rng.randint(0, 40) for _ in range(150)] + [None] * 20
    rows = [(i, f"{sentence(rng, 'en', 6)} {k}") for k, i in enumerate(ids)]
    rows += [(7, "the same"), (7, "the same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("tie", F.xxhash64("text"))
    got = fingerprints.with_next(df, ["text"], buckets).collect()
    order = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie), reverse=True)
    want = [(r.doc_id, r.text, order[(k + 1) % len(order)].text) for k, r in enumerate(order)]
    assert sorted(repr((r.doc_id, r.text, r.next_text)) for r in got) == sorted(map(repr, want))


def test_a_repeated_id_is_split():
    cuts = fingerprints.cuts_of([1, 5, 5, 5, 5, 9])
    assert cuts == sorted(cuts, reverse=True) and len(set(cuts)) == 6
    assert sum(i == 5 for i, _ in cuts) == 4


def test_merge_of_nulls(spark):
    parts = spark.createDataFrame([(1, None), (1, [5, 3]), (2, []), (None, [4]), (2, None)], "k int, s array<long>")
    got = {r.k: list(r.sketch) for r in fingerprints.merge(parts, "k", "s").collect()}
    assert got == {1: [3, 5], 2: [], None: [4]}
