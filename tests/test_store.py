"""What the store and the engine keep: deletes, replaced documents, runs that are cut off, failures of plug-ins."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import pages as pages_op
from factloom.plans import reads
from factloom.plans.engine import Engine
from factloom.plugins import PromptExtractor, ReplayExtractor, RuleJudge
from factloom.schemas import DOCUMENTS, FACTS, PAGES
from factloom.sources import files
from factloom.sources.store import Store
from factloom.streaming.ingest import stream_pages
from tests.test_engine import fact, pages_of, replies_of


def engine_of(spark, tmp_path, judge=None):
    recorded = replies_of(spark, [(d, 1, [fact(v)]) for d, v in (("one", "1,000"), ("two", "1000"), ("three", "900"))])
    return Engine(spark, f"file://{tmp_path}/store", ReplayExtractor(recorded), judge or RuleJudge())


def edges(engine):
    return engine.store.relationships().count()


def test_deleted_edges_stay_gone(spark, tmp_path):
    engine = engine_of(spark, tmp_path)
    engine.ingest(pages_of(spark, [("one", 1), ("two", 1)]))
    store = engine.store
    assert edges(engine) == 1
    docs = spark.createDataFrame(store.documents().where("doc_id = 'one'").collect(), DOCUMENTS)
    facts = spark.createDataFrame(store.facts().where("source_doc_id = 'one'").collect(), FACTS)
    assert engine.delete_document("one") and edges(engine) == 0
    # The same rows again, with the same ids: the judgement that was made on the deleted ones does not count.
    store.commit(documents=docs, facts=facts)
    assert store.facts().count() == 2 and edges(engine) == 0
    engine.reprocess(pages_of(spark, [("one", 1)]))
    assert store.facts().count() == 2 and edges(engine) == 1
    store.compact()
    assert store.facts().count() == 2 and edges(engine) == 1


def test_documents_ingested_again_are_replaced(spark, tmp_path):
    engine = engine_of(spark, tmp_path)
    for _ in range(2):
        row = engine.ingest(pages_of(spark, [("one", 2)])).first()
        assert (row.fact_count, row.page_count, row.status, row.message) == (1, 2, "extracted", "")
    engine.ingest(pages_of(spark, [("two", 1)]))
    engine.ingest(pages_of(spark, [("two", 1)]))
    assert tuple(engine.stats().first()) == (2, 2, 1)
    # A table is one scan, however many batches it has.
    plan = engine.store._batches("facts")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_a_run_that_is_cut_off_leaves_nothing(spark, tmp_path, monkeypatch):
    engine = engine_of(spark, tmp_path)
    source, mark = f"file://{tmp_path}/in", f"file://{tmp_path}/mark"
    pages_of(spark, [("one", 1), ("two", 1)]).write.parquet(source)

    def cut(*staged):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(engine.store, "publish", cut)
        with pytest.raises(Exception, match="lost"):
            stream_pages(engine, source, mark).awaitTermination(120)
    assert tuple(engine.stats().first()) == (0, 0, 0)
    stream_pages(engine, source, mark).awaitTermination(120)
    assert tuple(engine.stats().first()) == (2, 2, 1)


class BrokenJudge:
    def replies(self, pairs):
        raise RuntimeError("no such model")


def test_failures_are_told(spark, tmp_path):
    engine = engine_of(spark, tmp_path, BrokenJudge())
    row = engine.ingest(pages_of(spark, [("one", 1), ("three", 1)])).where("doc_id = 'one'").first()
    assert (row.status, row.fact_count, row.relationship_count) == ("partial_error", 1, 0) and "no such model" in row.message

    def model(prompt):
        if "page 2" in prompt:
            raise ValueError("too long")
        return json.dumps({"facts": [fact("1")]})

    replies = PromptExtractor(model).replies(pages_of(spark, [("x", 2)])).orderBy("page_number").collect()
    assert [(r.reply is None, r.error) for r in replies] == [(False, None), (True, "too long")]


def test_samples(spark, tmp_path):
    (tmp_path / "in/set").mkdir(parents=True)
    (tmp_path / "in/set/a-report.pdf").write_bytes(b"%PDF one")
    (tmp_path / "in/set/b-report.pdf").write_bytes(b"none")

    def reader(data, name):
        if not data.startswith(b"%"):
            raise ValueError("no pdf")
        return [{"page_number": 1, "text": data.decode() * 20}]

    engine = Engine(spark, f"file://{tmp_path}/store")
    row = engine.ingest_sample(f"file://{tmp_path}/in", "a_report", reader).first()
    assert (row.doc_name, row.page_count, row.status) == ("a-report.pdf", 1, "parsed_only")
    with pytest.raises(KeyError):
        engine.ingest_sample(f"file://{tmp_path}/in", "c_report", reader)
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{tmp_path}/in")
    assert [(r.doc_name, r.error) for r in files.unreadable(every, reader).collect()] == [("b-report.pdf", "no pdf")]


def test_lookups_and_lists(spark, tmp_path):
    engine = engine_of(spark, tmp_path)
    engine.ingest(pages_of(spark, [("one", 1)]))
    engine.ingest(pages_of(spark, [("two", 1)]))
    engine.ingest(pages_of(spark, [("three", 1)]))
    assert [r.doc_id for r in engine.documents().collect()] == ["three", "two", "one"]
    one = engine.facts("one").first()
    assert engine.fact(one.id).first().value == "1,000" and engine.fact("none").isEmpty()
    detail = engine.fact_detail(one.id).collect()
    assert len(detail) == 2 and all(r.fact.id == one.id and r.target_fact.id != one.id for r in detail)
    assert engine.relationships(cross_document=True).count() == 3
    assert engine.relationships(doc_id="one").count() == 2
    shown, related = engine.preview("one")
    assert shown.count() == 1 and related.count() == 2


def test_table_counts(spark):
    grid = [[["a", "b"], ["c", "d"]], [], [["e"]]]
    rows = [("d", "d", 1, "x" * 80, grid, None, None), ("d", "d", 2, "y" * 80, None, 4, 9), ("d", "d", 3, " \n", grid, None, None), ("e", "e", 1, "z" * 80, None, None, None)]
    made = spark.createDataFrame(rows, PAGES)
    counted = pages_op.with_density(made).orderBy("doc_id", "page_number").select("table_count", "table_row_count").collect()
    assert [tuple(r) for r in counted] == [(2, 3), (4, 9), (0, 0)]
    got = {r.doc_id: (r.pages, r.pages_with_tables, r.tables, r.table_rows) for r in reads.table_counts(made).collect()}
    assert got == {"d": (2, 2, 6, 12), "e": (1, 0, 0, 0)}
    assert pages_op.with_table_counts(made.select("doc_id", "text")).select(F.sum("table_count")).first()[0] == 0


def test_two_writers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    docs = spark.createDataFrame([("a",)], "doc_id string").selectExpr("doc_id", "doc_id AS doc_name", "1 AS page_count", "1 AS total_pages", "current_timestamp() AS created_at")
    late = store.stage(documents=docs)
    store.commit(documents=docs)
    with pytest.raises(RuntimeError):
        store.publish(late)
