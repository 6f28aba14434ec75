"""Operators on tables without rows that no other test gives them, and names of columns that clash."""

from __future__ import annotations

from factloom.llm import decontaminate, language, simhash
from tests.llm.helpers import DOCS, clashing, frame


def test_empty_documents(spark):
    none = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(spark, none).count() == 0
    queries = spark.createDataFrame([(1, "river stone")], "item_id long, text string")
    assert decontaminate.proximity_matches(spark, none, queries, 5).count() == 0


def test_empty_queries(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.proximity_matches(spark, frame(spark), none, 5).count() == 0
    blank = spark.createDataFrame([(1, " - "), (2, None)], "item_id long, text string")
    assert decontaminate.proximity_matches(spark, frame(spark), blank, 5).count() == 0


def test_other_columns_of_language(spark):
    df = clashing(frame(spark))
    found = language.identify(df, None)
    assert [c for c in found.columns if c not in ("lang_pred", "lang_score")] == [c for c in df.columns if c not in ("lang_pred", "lang_score")]
