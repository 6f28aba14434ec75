"""The engine end to end on a small store: ingest, read, search, compare, reprocess, delete, export, stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import pages
from factloom.plans import reads
from factloom.plans.engine import Engine
from factloom.plugins import ReplayExtractor, RuleJudge, extraction_prompt, pair_prompt, retrying
from factloom.schemas import PAGES
from factloom.sources import files
from factloom.streaming.ingest import stream_pages

FILLER = "The company reports revenue and profit for the year in the table below, with growth of 8.2% over 2023."


def fact(value, scope="FY2024", attribute="Total revenue", unit="INR million", **more):
    return {"subject": "Acme Limited", "attribute": attribute, "value": value, "unit": unit, "temporal_scope": scope, "confidence": 0.9} | more


def pages_of(spark, docs):
    rows = [(d, f"{d}.pdf", n, FILLER + f" page {n}", None, 0, 0) for d, n_pages in docs for n in range(1, n_pages + 1)]
    return spark.createDataFrame(rows, PAGES)


def replies_of(spark, rows):
    return spark.createDataFrame([(d, n, json.dumps({"facts": fs})) for d, n, fs in rows], "doc_id string, page_number int, reply string")


@pytest.fixture
def engine(spark, tmp_path):
    recorded = replies_of(
        spark,
        [
            ("one", 1, [fact("1,000"), fact("7%", attribute="Net profit margin", unit=None)]),
            ("two", 1, [fact("1000.4"), fact("5", attribute="x" * 61), fact("", attribute="Total revenue")]),
            ("three", 1, [fact("100", unit="INR Crore", attribute="Revenue from operations"), fact("900")]),
        ],
    )
    return Engine(spark, f"file://{tmp_path}/store", ReplayExtractor(recorded), RuleJudge())


def test_lifecycle(spark, engine, tmp_path):
    first = engine.ingest(pages_of(spark, [("one", 2)])).collect()
    assert [(r.doc_id, r.page_count, r.fact_count, r.relationship_count, r.status) for r in first] == [("one", 2, 2, 0, "extracted")]
    second = engine.ingest(pages_of(spark, [("two", 1)])).first()
    assert (second.fact_count, second.relationship_count) == (1, 1)
    engine.ingest(pages_of(spark, [("three", 1)]))
    edges = {(r.relation_type, r.match_source) for r in engine.relationships().collect()}
    assert ("corroborates", "structural") in edges and len(edges) > 1
    # Million against crore under one fingerprint, through the fuzzy lane.
    assert engine.relationships("corroborates").where("fact_1.unit <> fact_2.unit").count() >= 1
    stats = engine.stats().first()
    assert (stats.documents, stats.facts) == (3, 5)
    assert {r.doc_id: r.fact_count for r in engine.documents().collect()} == {"one": 2, "two": 1, "three": 2}
    assert engine.document("two").first().relationship_count >= 1
    ids = [r.id for r in engine.facts().orderBy("id").collect()]
    assert engine.facts(search=" ACME ").count() == 5 and engine.facts(search="margin").count() == 1
    assert engine.facts("one").count() == 2
    with pytest.raises(ValueError):
        engine.facts(limit=0)
    assert engine.fact_detail(ids[0]).count() == engine.fact_related(ids[0]).count()
    assert engine.document_relationships("three").count() >= 1
    some = engine.store.relationships().first()
    assert engine.relationship(some.id).first().fact_1.id == some.fact_id_1
    assert {r.name for r in engine.canonicals().where("kind = 'subject'").collect()} == {"Acme Limited"}

    before = engine.store.relationships().count()
    made = engine.compare(ids[0], ids[-1]).first()
    assert made.match_source == "fuzzy" and engine.store.relationships().count() == before + 1
    with pytest.raises(KeyError):
        engine.compare(ids[0], "nothing")

    engine.reprocess(pages_of(spark, [("two", 1)]))
    assert engine.stats().first().facts == 5

    engine.export(f"file://{tmp_path}/export")
    assert spark.read.json(f"file://{tmp_path}/export/facts").count() == 5

    assert engine.delete_document("one") and not engine.delete_document("one")
    assert engine.stats().first().facts == 3
    assert reads.dangling(engine.store.relationships(), engine.store.facts()).count() == 0
    engine.store.compact()
    assert engine.stats().first().facts == 3
    engine.reset()
    assert tuple(engine.stats().first()) == (0, 0, 0)


def test_no_extractor_only_parses(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    row = engine.ingest(pages_of(spark, [("one", 20)])).first()
    assert (row.page_count, row.fact_count, row.status) == (15, 0, "parsed_only")


def test_page_selection(spark):
    rows = [("d", "d", n, text, None, t, 0) for n, text, t in [
        (1, "Table of contents " + FILLER, 9), (2, FILLER, 0), (3, FILLER, 0), (4, FILLER, 2), (5, "tiny", 9), (6, FILLER, 2), (7, " ", 0)]]
    rows += [("front", "f", n, "preface " + FILLER, None, 0, 0) for n in (1, 2)]
    scored = pages.with_density(spark.createDataFrame(rows, PAGES))
    assert scored.where("doc_id = 'd'").count() == 6
    chosen = pages.select_pages(scored, 15).orderBy("doc_id", "page_number").collect()
    assert [(r.doc_id, r.page_number) for r in chosen] == [("d", 2), ("d", 4), ("d", 6), ("front", 1), ("front", 2)]
    assert pages.gate(scored, 3).where("doc_id = 'd'").count() == 3
    assert [pages.effective_gate(x) for x in (None, 0, -1, 4)] == [15, None, None, 4]
    assert pages.top_pages(scored, 6).where("doc_id = 'd'").count() == 5


def test_stream_takes_each_document_once(spark, engine, tmp_path):
    source, mark = f"file://{tmp_path}/in", f"file://{tmp_path}/mark"
    pages_of(spark, [("one", 1)]).write.parquet(source)
    stream_pages(engine, source, mark).awaitTermination(60)
    pages_of(spark, [("two", 1), ("one", 1)]).write.mode("append").parquet(source)
    stream_pages(engine, source, mark).awaitTermination(60)
    stream_pages(engine, source, mark).awaitTermination(60)
    assert engine.stats().first().documents == 2


def test_files(spark, tmp_path):
    for name, data in {"set-a/01-big-report.pdf": b"%PDF", "set-a/empty.pdf": b"", "set-b/01-big-report.PDF": b"%PDF2", "set-b/x.txt": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.find_files(spark, f"file://{tmp_path}").collect()
    assert [(r.key, r.title, r.category) for r in found] == [("01_big_report", "Big Report", "Set B")]
    read = files.read_pages(
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{tmp_path}"),
        lambda data, name: [{"page_number": 1, "text": data.decode()}] if data.startswith(b"%") else (_ for _ in ()).throw(ValueError("no pdf")),
    )
    assert sorted(r.text for r in read.collect()) == ["%PDF", "%PDF2"]


def test_layout(spark):
    words = [("d", 1, i, *w) for i, w in enumerate([
        (50.0, 10.0, 60.0, 12.0, "b"), (10.0, 11.0, 20.0, 13.0, "a"), (10.0, 30.0, 20.0, 32.0, "c"), (5.0, 14.0, 6.0, 14.2, "late")])]
    got = files.layout_text(spark.createDataFrame(words, "doc_id string, page_number int, word_no int, x0 double, y0 double, x1 double, y1 double, word string"))
    assert got.first().text == "late a b\nc"
    assert files.assemble_lines([]) == ""


def test_prompts_and_retries(spark):
    prompt = extraction_prompt(pages_of(spark, [("one", 1)])).first().prompt
    assert "one.pdf" in prompt and FILLER in prompt
    sides = "struct<source_doc:string,page:int,subject:string,subject_normalized:string,attribute:string,attribute_normalized:string,value:string,unit:string,temporal_scope:string,conditions:string,evidence_quote:string>"
    f = ("d", 1, "s", "s", "a", "a", "1", None, None, None, "q")
    text = pair_prompt(spark.createDataFrame([(f, f)], f"fact_1 {sides}, fact_2 {sides}")).first().prompt
    assert "unspecified" in text and "none" in text
    waits, calls = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError("429: try again in 6.5s" if len(calls) == 1 else "quota")
        return "ok"

    assert retrying(flaky, sleep=waits.append)("p") == "ok" and waits == [7.5, 6.0]

    def broken(prompt):
        raise RuntimeError("bad key")

    assert retrying(broken, sleep=waits.append)("p") is None


def test_views_of_facts(spark, engine):
    engine.ingest(pages_of(spark, [("one", 1)]))
    shown = reads.fact_view(engine.store.facts()).where(F.col("attribute") == "Total revenue").first()
    assert (shown.shown_value, shown.confidence_percent) == ("1,000 INR million", 90)
