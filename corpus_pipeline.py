"""A pipeline over ``documents``: language, near-duplicates, benchmark contamination, personal data, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame that is written and read back as the next one's ``docs``. All but the last return the columns that
came in. Each stage's treatment of nulls, ties, repeated rows and empty tables is that of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, language, packing, pii, resemblance
from factloom.llm.common import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the network is trained on the documents that come in."""
    return language.keep_languages(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a resemblance of 0.8 or more, that of the smallest id.

    Candidates come from the SimHash index and, as 0.8 is too wide for it alone, from min-wise bands; links are exact.
    """
    return resemblance.keep_one(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth is benchmark text."""
    return decontaminate.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("pack", pack_sequences),
]

#: Training, a byte network and a tokenizer are not SQL: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
