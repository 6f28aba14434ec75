"""The engine's API: ingest documents, find and judge pairs, read, search, export and delete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import density, llmjson
from factloom.operators import facts as facts_op
from factloom.operators import matching, pages, reconcile
from factloom.plans import reads
from factloom.sources import files
from factloom.sources.store import Store


class Engine:
    """``extractor`` and ``judge`` are plug-ins; without them only what rules can do is done."""

    def __init__(self, spark: SparkSession, root: str, extractor=None, judge=None):  # noqa: ANN001
        self.spark, self.store = spark, Store(spark, root)
        self.extractor, self.judge = extractor, judge

    # Ingest -----------------------------------------------------------------------------------------------------------

    def extract(self, page_rows: DataFrame, max_pages: int | None = None) -> DataFrame:
        """Facts of the selected pages of documents in ``page_rows``."""
        chosen = pages.select_pages(pages.with_density(page_rows), pages.effective_gate(max_pages))
        replies = self.extractor.replies(chosen).select("doc_id", "doc_name", F.col("page_number").alias("page"), "reply")
        return facts_op.resolve(llmjson.explode_facts(replies, "reply").withColumn("created_at", F.current_timestamp()))

    def ingest(self, page_rows: DataFrame, max_pages: int | None = None, candidates: int | None = matching.CANDIDATES_PER_INGEST) -> DataFrame:
        """Store documents, their facts and their relationships; one row a document with counts and a status.

        All of it is one version of the store, so a run that is cut off leaves nothing behind, and documents that are
        stored already are replaced. If extraction or judging fails, what was made before is stored and the status is
        ``partial_error`` with the error as ``message``.
        """
        store = self.store
        kept = pages.gate(page_rows.where(density.not_blank(F.col("text"))), pages.effective_gate(max_pages))
        docs = page_rows.groupBy("doc_id").agg(F.first("doc_name").alias("doc_name"), F.count("*").cast("int").alias("total_pages"))
        counted = kept.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
        docs = docs.join(counted, "doc_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))
        docs = docs.withColumn("created_at", F.current_timestamp())
        ids = page_rows.select("doc_id").distinct()
        staged = [store.stage(tombstones=store.tombstones(ids), documents=docs)]
        status, message = "parsed_only", ""
        if self.extractor is not None:
            status, message = self._extend(staged, page_rows, max_pages, candidates)
        store.publish(*staged)
        return self._status(page_rows, status, message)

    def _extend(self, staged: list[dict[str, str]], page_rows: DataFrame, max_pages: int | None, candidates: int | None) -> tuple[str, str]:
        """Stage the facts of pages and their relationships; (status, message)."""
        try:
            staged.append(self.store.stage(facts=self.extract(page_rows, max_pages)))
            new = self.store.read("facts", [staged[-1]["facts"]]).drop("__v")
            everything = self.store.facts(staged)
            judged = self.store.relationships(staged).select("fact_id_1", "fact_id_2")
            pairs = matching.top_candidates(matching.candidates(new, everything, judged), candidates)
            made = reconcile.judge_and_collect(pairs, everything, self.judge, F.current_timestamp())
            staged.append(self.store.stage(relationships=made))
        except Exception as e:  # a plug-in may raise anything; the status says what
            return "partial_error", str(e)
        return "extracted", ""

    def ingest_sample(self, root: str, key: str, reader: Callable[[bytes, str], list[dict]], max_pages: int | None = None) -> DataFrame:
        """Find the document file with a key below ``root``, read its pages and ingest them."""
        found = files.find_files(self.spark, root).where(F.col("key") == key).first()
        if found is None:
            raise KeyError(f"no sample {key}")
        content = self.spark.read.format("binaryFile").load(found.path)
        return self.ingest(files.read_pages(content, reader), max_pages)

    def reprocess(self, page_rows: DataFrame, max_pages: int | None = None) -> DataFrame:
        """Extract one document anew, in place of its facts and relationships; its document row stays as it is.

        If extraction fails, what was stored stays.
        """
        doc_id = page_rows.select("doc_id").first()[0]
        docs = self.store.documents().where(F.col("doc_id") == doc_id)
        staged = [self.store.stage(tombstones=self.store.tombstones(docs.select("doc_id")), documents=docs)]
        status, message = self._extend(staged, page_rows, max_pages, matching.CANDIDATES_PER_INGEST)
        if any("facts" in s for s in staged):
            self.store.publish(*staged)
        return self._status(page_rows, status, message)

    def _status(self, page_rows: DataFrame, status: str, message: str) -> DataFrame:
        ids = page_rows.select("doc_id").distinct()
        listed = self.documents().join(ids, "doc_id", "left_semi")
        edges = reads.relationship_counts(self.store.relationships(), self.store.facts())
        out = listed.join(edges, "doc_id", "left").select(
            "doc_id", "doc_name", "page_count", "fact_count", F.coalesce("relationship_count", F.lit(0)).alias("relationship_count")
        )
        return out.withColumn("status", F.lit(status)).withColumn("message", F.lit(message))

    def preview(self, doc_id: str) -> tuple[DataFrame, DataFrame]:
        """The first facts and relationships of an ingested document."""
        facts = reads.list_facts(self.store.facts(), doc_id, limit=reads.PREVIEW_FACTS)
        edges = reads.touching_document(self.store.relationships(), self.store.facts(), doc_id)
        return facts, edges.orderBy("created_at", "id").limit(reads.PREVIEW_RELATIONSHIPS)

    # Reads ------------------------------------------------------------------------------------------------------------

    def documents(self) -> DataFrame:
        """All documents from the newest, with their numbers of facts."""
        return reads.newest_first(reads.documents_with_counts(self.store.documents(), self.store.facts()))

    def document(self, doc_id: str) -> DataFrame:
        edges = reads.relationship_counts(self.store.relationships(), self.store.facts())
        return self.documents().where(F.col("doc_id") == doc_id).join(edges, "doc_id", "left").fillna(0, ["relationship_count"])

    def facts(self, doc_id: str | None = None, search: str | None = None, limit: int = 500, limit_then_search: bool = False) -> DataFrame:
        return reads.list_facts(self.store.facts(), doc_id, search, limit, limit_then_search)

    def fact(self, fact_id: str) -> DataFrame:
        return reads.fact(self.store.facts(), fact_id)

    def fact_detail(self, fact_id: str) -> DataFrame:
        return reads.fact_detail(self.store.relationships(), self.store.facts(), fact_id)

    def fact_related(self, fact_id: str) -> DataFrame:
        return reads.neighbours(self.store.relationships(), self.store.facts(), fact_id, "left")

    def relationships(
        self, relation_type: str | None = None, limit: int = 500, cross_document: bool = False, doc_id: str | None = None
    ) -> DataFrame:
        return reads.list_relationships(self.store.relationships(), self.store.facts(), relation_type, limit, cross_document, doc_id)

    def relationship(self, relationship_id: str) -> DataFrame:
        return reconcile.with_facts(self.store.relationships().where(F.col("id") == relationship_id), self.store.facts(), "left")

    def document_relationships(self, doc_id: str) -> DataFrame:
        edges = reads.touching_document(self.store.relationships(), self.store.facts(), doc_id)
        return reconcile.with_facts(edges, self.store.facts(), "left")

    def canonicals(self) -> DataFrame:
        return reads.canonicals(self.store.facts())

    def stats(self) -> DataFrame:
        return reads.stats(self.store.documents(), self.store.facts(), self.store.relationships())

    def telemetry(self, page_rows: DataFrame, max_pages: int | None = None) -> DataFrame:
        return reads.page_telemetry(pages.with_density(page_rows), pages.effective_gate(max_pages))

    def export(self, path: str) -> None:
        """Write each table as JSON lines below ``path``, in parallel, with a row of counts and the time beside them."""
        tables = {"documents": self.documents(), "facts": self.store.facts(), "relationships": self.store.relationships()}
        for name, rows in tables.items():
            rows.write.mode("overwrite").json(f"{path}/{name}")
        self.stats().withColumn("timestamp", F.current_timestamp()).write.mode("overwrite").json(f"{path}/counts")

    # Changes ----------------------------------------------------------------------------------------------------------

    def compare(self, fact_id_1: str, fact_id_2: str) -> DataFrame:
        """Judge two facts now, store the relationship and return it."""
        facts = self.store.facts()
        found = facts.where(F.col("id").isin(fact_id_1, fact_id_2))
        ids = sorted([fact_id_1, fact_id_2])
        if found.count() != len(set(ids)):
            raise KeyError("no such fact")
        pair = self.spark.createDataFrame([(*ids, "fuzzy")], "fact_id_1 string, fact_id_2 string, match_source string")
        met = reconcile.with_facts(pair, facts).withColumn("is_intra_document", F.col("fact_1.source_doc_id") == F.col("fact_2.source_doc_id"))
        made = reconcile.from_replies(self.judge.replies(met), F.current_timestamp())
        staged = self.store.stage(relationships=made)
        self.store.publish(staged)
        return self.store.read("relationships", [staged["relationships"]]).drop("__v")

    def delete_document(self, doc_id: str) -> bool:
        return self.store.delete_document(doc_id)

    def reset(self) -> None:
        self.store.reset()
