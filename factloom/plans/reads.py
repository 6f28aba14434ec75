"""Reads over the three relations: lists, search, neighbours, counts. Each is one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import density
from factloom.operators import pages as pages_op
from factloom.operators.reconcile import with_facts

SERVER_FIELDS = ("subject", "attribute", "value", "evidence_quote")
CLIENT_FIELDS = (*SERVER_FIELDS, "subject_normalized", "attribute_normalized")
LEAST_LIMIT, MOST_LIMIT = 1, 2000
PREVIEW_FACTS, PREVIEW_RELATIONSHIPS = 15, 10


def checked_limit(limit: int) -> int:
    if not LEAST_LIMIT <= limit <= MOST_LIMIT:
        raise ValueError(f"limit must be {LEAST_LIMIT} to {MOST_LIMIT}")
    return limit


def matches(query: str, fields: tuple[str, ...], trim: bool) -> Column:
    """A literal substring of any field, without regard to case; an empty query matches everything."""
    q = F.lit((query.strip() if trim else query).lower())
    out = F.lit(False)
    for f in fields:
        out = out | F.contains(F.lower(F.coalesce(f, F.lit(""))), q)
    return out


def list_facts(facts: DataFrame, doc_id: str | None = None, search: str | None = None, limit: int = 500, limit_then_search: bool = False) -> DataFrame:
    """A document's facts by page and time, or all from the newest; ids settle ties.

    The search goes before the limit, or after it with ``limit_then_search``.
    """
    rows = facts if doc_id is None else facts.where(F.col("source_doc_id") == doc_id)
    order = [F.desc("created_at"), "id"] if doc_id is None else ["page", "created_at", "id"]
    test = matches(search, SERVER_FIELDS, trim=True) if search else F.lit(True)
    n = checked_limit(limit)
    if limit_then_search:
        return rows.orderBy(*order).limit(n).where(test)
    return rows.where(test).orderBy(*order).limit(n)


def search_facts(facts: DataFrame, query: str, doc_id: str | None = None) -> DataFrame:
    """The browser's search: six fields, the query as typed."""
    rows = facts if doc_id is None else facts.where(F.col("source_doc_id") == doc_id)
    return rows.where(matches(query, CLIENT_FIELDS, trim=False))


def fact_view(facts: DataFrame) -> DataFrame:
    """A fact as shown: period with a default, value with unit, confidence in percent."""
    return facts.select(
        "id", "subject", "attribute",
        F.trim(F.concat_ws(" ", "value", F.coalesce("unit", F.lit("")))).alias("shown_value"),
        F.coalesce(F.nullif("temporal_scope", F.lit("")), F.lit("unspecified")).alias("shown_scope"),
        F.floor(F.col("confidence") * 100 + 0.5).cast("int").alias("confidence_percent"),
        "source_doc", "page",
    )


def list_relationships(
    relationships: DataFrame,
    facts: DataFrame,
    relation_type: str | None = None,
    limit: int = 500,
    cross_document: bool = False,
    doc_id: str | None = None,
) -> DataFrame:
    """Relationships from the newest, with their facts (null where one is missing).

    ``cross_document`` leaves out those inside one document, ``doc_id`` those that don't touch the document.
    """
    rows = relationships if doc_id is None else touching_document(relationships, facts, doc_id)
    rows = rows if relation_type is None else rows.where(F.col("relation_type") == relation_type)
    if cross_document:
        rows = rows.where(~F.col("is_intra_document"))
    newest = rows.orderBy(F.desc("created_at"), "id").limit(checked_limit(limit))
    return with_facts(newest, facts, "left")


def _with_ends(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """Relationships, read once, with ``__1`` and ``__2``: true where that end is among ``facts``, else null."""
    ids = facts.select("id").distinct()
    for n in ("1", "2"):
        ends = ids.select(F.col("id").alias(f"fact_id_{n}"), F.lit(True).alias(f"__{n}"))
        relationships = relationships.join(ends, f"fact_id_{n}", "left")
    return relationships


def touching_document(relationships: DataFrame, facts: DataFrame, doc_id: str) -> DataFrame:
    """Relationships with a fact of the document at either end."""
    own = facts.where(F.col("source_doc_id") == doc_id)
    return _with_ends(relationships, own).where("__1 OR __2").select(*relationships.columns)


def neighbours(relationships: DataFrame, facts: DataFrame, fact_id: str, how: str) -> DataFrame:
    """A fact's relationships with the fact at the other end as ``target_fact``; a loop's other end is itself."""
    mine = relationships.where((F.col("fact_id_1") == fact_id) | (F.col("fact_id_2") == fact_id))
    other = F.when(F.col("fact_id_1") == fact_id, F.col("fact_id_2")).otherwise(F.col("fact_id_1"))
    target = facts.select(F.col("id").alias("other_id"), F.struct("*").alias("target_fact"))
    return mine.withColumn("other_id", other).join(target, "other_id", how)


def fact(facts: DataFrame, fact_id: str) -> DataFrame:
    return facts.where(F.col("id") == fact_id)


def fact_detail(relationships: DataFrame, facts: DataFrame, fact_id: str) -> DataFrame:
    """A row for each related fact: the relationship, ``target_fact``, and the fact itself as ``fact``."""
    own = fact(facts, fact_id).select(F.col("id").alias("__id"), F.struct("*").alias("fact"))
    met = neighbours(relationships, facts, fact_id, "inner")
    return met.withColumn("__id", F.lit(fact_id)).join(own, "__id").drop("__id")


def documents_with_counts(documents: DataFrame, facts: DataFrame) -> DataFrame:
    counts = facts.groupBy(F.col("source_doc_id").alias("doc_id")).agg(F.count("*").alias("fact_count"))
    return documents.join(counts, "doc_id", "left").withColumn("fact_count", F.coalesce("fact_count", F.lit(0).cast("long")))


def newest_first(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("created_at"), "doc_id")


def table_counts(pages: DataFrame) -> DataFrame:
    """Per document: pages with text, pages with tables, tables and table rows."""
    counted = pages_op.with_table_counts(pages.where(density.not_blank(F.col("text"))))
    return counted.groupBy("doc_id").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("table_count") > 0).alias("pages_with_tables"),
        F.sum("table_count").cast("long").alias("tables"),
        F.sum("table_row_count").cast("long").alias("table_rows"),
    )


def relationship_counts(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """Per document the number of relationships that touch it."""
    ends = relationships.select("id", F.explode(F.array("fact_id_1", "fact_id_2")).alias("fact_id"))
    docs = facts.select(F.col("id").alias("fact_id"), F.col("source_doc_id").alias("doc_id"))
    return ends.join(docs, "fact_id").select("doc_id", "id").distinct().groupBy("doc_id").agg(F.count("*").alias("relationship_count"))


def stats(documents: DataFrame, facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row with the three counts; each is summed from partial counts."""
    counted = [d.groupBy().agg(F.count("*").alias(n)) for d, n in ((documents, "documents"), (facts, "facts"), (relationships, "relationships"))]
    rows = [d.select(*[F.col(n) if n == c else F.lit(0).cast("long").alias(n) for n in ("documents", "facts", "relationships")])
            for d, c in zip(counted, ("documents", "facts", "relationships"), strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(*[F.sum(n).alias(n) for n in ("documents", "facts", "relationships")])


def canonicals(facts: DataFrame) -> DataFrame:
    """(kind, name): the distinct subjects and attributes."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("subject", "attribute")]))
    return facts.select(named.alias("n")).select("n.kind", "n.name").where("name IS NOT NULL AND name <> ''").distinct()


def dangling(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """Relationships that name a fact that is not there."""
    return _with_ends(relationships, facts).where("__1 IS NULL OR __2 IS NULL").select(*relationships.columns)


def page_telemetry(scored: DataFrame, max_pages: int | None) -> DataFrame:
    """Per document: pages, front-matter pages, pages sent to extraction, pages skipped, calls saved a call made."""
    sent = pages_op.select_pages(scored, max_pages).groupBy("doc_id").agg(F.count("*").alias("sent"))
    all_ = scored.groupBy("doc_id").agg(
        F.count("*").alias("pages"),
        F.count_if("is_front_matter").alias("front_matter_pages"),
        F.count_if(~density.has_text(F.col("text"))).alias("short_pages"),
    )
    made = all_.join(sent, "doc_id", "left").withColumn("sent", F.coalesce("sent", F.lit(0).cast("long")))
    return made.withColumn("skipped", F.greatest(F.lit(0), F.col("pages") - F.col("sent"))).withColumn(
        "reduction", F.col("pages") / F.greatest(F.col("sent"), F.lit(1))
    )
