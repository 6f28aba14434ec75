"""The pipeline stage by stage against what the stages' operators mean, and the registered queries on the small tables."""

from __future__ import annotations

import re

import corpus_pipeline
from factloom.llm import registry
from tests.conftest import SMALL
from tests.llm.helpers import DOCS, clashing, frame
from tests.llm.test_operators import brute_components, brute_contamination, brute_simhash, brute_spans


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    columns = docs.columns
    before = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        if name == "language":
            kept = {r.doc_id for r in rows}
            assert all(r.doc_id in kept for r in before if re.search(r"[^\W\d_]", r.text or "") and len(r.text) > 200)
        if name == "near_duplicates":
            fp = {r.doc_id: brute_simhash(r.text) for r in before}
            root = brute_components(fp.values())
            least: dict[int, int] = {}
            for d, f in sorted(fp.items()):
                least.setdefault(root[f], d)
            assert sorted(r.doc_id for r in rows) == sorted(least.values())
        if name == "decontaminate":
            clean = {d for d, *_, bad in brute_contamination([(r.doc_id, r.text) for r in before], bench) if not bad}
            assert {r.doc_id for r in rows} == clean
        if name == "personal_data":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}
            assert not any(brute_spans(r.text) for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "pack":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}
        else:
            assert docs.columns == columns
        before = rows
    assert corpus_pipeline.run(spark, SMALL).count() == len(before)


def test_stages_on_awkward_rows(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (clashing(frame(spark)), spark.createDataFrame([], DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "pack":
                assert out.columns == docs.columns
            out.count()


def test_registered_queries(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for number in range(1, 11):
        name = next(q for q in registry.QUERIES if q.startswith(f"op{number}_"))
        rows = registry.QUERIES[name](spark, SMALL).count()
        assert rows == 50 if number == 9 else rows >= n if number == 4 else rows == n
