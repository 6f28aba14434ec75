"""From extracted facts to stored facts: validity, defaults, normal forms, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import normalize as N
from factloom.schemas import FACT_COLUMNS

MOST_CHARS, MOST_WORDS = 60, 8
DEFAULT_CONFIDENCE = 0.85


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\s\p{Z}]+"))


def valid(facts: DataFrame) -> DataFrame:
    """Facts with a subject, attribute and value, of which the last two are short; the three are trimmed."""
    clean = facts.withColumns({c: N.trimmed(F.coalesce(c, F.lit(""))) for c in ("subject", "attribute", "value")})
    short = [(F.length(c) <= MOST_CHARS) & (word_count(F.col(c)) <= MOST_WORDS) for c in ("value", "attribute")]
    return clean.where((F.col("subject") != "") & (F.col("attribute") != "") & (F.col("value") != "") & short[0] & short[1])


def confidence(raw: Column) -> Column:
    """Between 0 and 1; the default when it is missing or no number."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw.try_cast("double"), F.lit(DEFAULT_CONFIDENCE))))


def evidence() -> Column:
    """The quote, or a sentence made of the claim."""
    made = F.concat(F.col("subject"), F.lit(" "), F.col("attribute"), F.lit(": "), F.col("value"))
    return F.coalesce(F.nullif(N.trimmed(F.coalesce("evidence_quote", F.lit(""))), F.lit("")), made)


def group_id(doc_id: Column, page: Column, group: Column) -> Column:
    return F.when(group.isNotNull() & (group != ""), F.concat_ws("_", doc_id, page.cast("string"), group))


def resolve(extracted: DataFrame) -> DataFrame:
    """Stored form of extracted facts.

    Needs doc_id, doc_name, page, fact_no, the fields of a fact, and created_at. Ids are hashes of what a fact says and
    where, so a repeated run makes the same ids and a retried task changes nothing.
    """
    rows = valid(extracted).withColumn("evidence_quote", evidence()).withColumn("confidence", confidence(F.col("confidence")))
    named = {c: N.snake_case(F.coalesce(F.nullif(F.col(f"{c}_normalized"), F.lit("")), F.col(c))) for c in ("subject", "attribute")}
    rows = rows.withColumns({f"{c}_normalized": named[c] for c in named})
    rows = rows.withColumns(
        {
            "claim_fingerprint": N.claim_fingerprint(F.col("subject_normalized"), F.col("attribute_normalized"), F.col("temporal_scope")),
            "extraction_group_id": group_id(F.col("doc_id"), F.col("page"), F.col("extraction_group_id")),
            "id": F.sha2(
                F.concat_ws("\x1f", "doc_id", F.col("page").cast("string"), F.col("fact_no").cast("string"), "subject", "attribute", "value",
                            F.coalesce("unit", F.lit("")), F.coalesce("temporal_scope", F.lit(""))), 256
            ),
            "source_doc": F.col("doc_name"),
            "source_doc_id": F.col("doc_id"),
        }
    )
    return rows.select(*FACT_COLUMNS)
