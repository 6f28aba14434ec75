"""Schemas of the stored relations and of page chunks."""

from __future__ import annotations

DOCUMENTS = "doc_id string, doc_name string, page_count int, total_pages int, created_at timestamp"
FACTS = (
    "id string, subject string, subject_normalized string, attribute string, attribute_normalized string, value string, "
    "unit string, temporal_scope string, conditions string, claim_fingerprint string, extraction_group_id string, "
    "source_doc string, source_doc_id string, page int, evidence_quote string, confidence double, created_at timestamp"
)
RELATIONSHIPS = (
    "id string, fact_id_1 string, fact_id_2 string, relation_type string, reconciling_factor string, explanation string, "
    "match_source string, is_intra_document boolean, agreement_strength double, created_at timestamp"
)
PAGES = (
    "doc_id string, doc_name string, page_number int, text string, tables array<array<array<string>>>, "
    "table_count int, table_row_count int"
)
FACT_COLUMNS = tuple(c.split()[0] for c in FACTS.split(", "))
RELATIONSHIP_COLUMNS = tuple(c.split()[0] for c in RELATIONSHIPS.split(", "))
