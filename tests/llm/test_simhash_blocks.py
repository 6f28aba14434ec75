"""Hot values of the SimHash index are split without losing a pair."""

from __future__ import annotations

import random

import pytest

from factloom.llm import simhash
from factloom.llm.common import Scratch


def test_masks_cover_all_pairs():
    rng = random.Random(2)
    for mask in ((1 << 21) - 1, (1 << 40) - 1, ~0b1011 & (1 << 64) - 1):
        finer = simhash.finer_masks(mask)
        assert all(m & mask == mask for m in finer)
        rest = [i for i in range(64) if not mask >> i & 1]
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << i for i in rng.sample(rest, min(len(rest), rng.randint(0, 2))))
            assert any(a & m == b & m for m in finer)


@pytest.mark.parametrize("hot", [2, 9, 60])
def test_hot_values_at_many_levels(spark, hot):
    rng = random.Random(hot)
    fps = {rng.getrandbits(8) << 56 | rng.getrandbits(3) for _ in range(150)}
    fps |= {f ^ 1 << rng.randrange(64) for f in list(fps)[:60]}
    rows = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long").repartition(3)
    scratch = Scratch(spark, "t")
    found = simhash.components(simhash.fingerprint_edges(rows, hot, scratch), scratch)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in found.collect()}
    groups = {}
    for f in fps:
        groups.setdefault(got.get(f, f), set()).add(f)
    want, left = [], set(fps)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            f = todo.pop()
            group.add(f)
            near = {g for g in left if (f ^ g).bit_count() <= 2}
            left -= near
            todo += near
        want.append(group)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))
