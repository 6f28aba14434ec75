"""A streaming front-end: page files that arrive are ingested micro-batch by micro-batch through the batch plan.

Facts have no event time, so there is no watermark and no state store: state is the stored facts. Ids are hashes of
content and a batch's commit is one version, so a batch that runs again adds nothing that is already stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from factloom.plans.engine import Engine
from factloom.schemas import PAGES


def ingest_new(engine: Engine, batch: DataFrame, max_pages: int | None = None) -> None:
    """Ingest the documents of a batch that are not stored yet."""
    stored = engine.store.documents().select("doc_id").distinct()
    fresh = batch.join(stored, "doc_id", "left_anti")
    if not fresh.isEmpty():
        engine.ingest(fresh, max_pages)


def stream_pages(engine: Engine, source: str, checkpoint: str, max_pages: int | None = None) -> StreamingQuery:
    """Ingest all page files under ``source`` that no earlier run has taken, then stop."""
    rows = engine.spark.readStream.schema(PAGES).parquet(source)
    writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, _: ingest_new(engine, batch, max_pages)).start()


