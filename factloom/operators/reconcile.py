"""From candidate pairs to relationships: the deterministic phase first, a judge for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import judging as J
from factloom.functions import llmjson
from factloom.schemas import RELATIONSHIP_COLUMNS


def with_facts(pairs: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs or relationships with both facts as the structs ``fact_1`` and ``fact_2``."""
    one = facts.select(F.col("id").alias("__id1"), F.struct("*").alias("fact_1"))
    two = facts.select(F.col("id").alias("__id2"), F.struct("*").alias("fact_2"))
    met = pairs.join(one, F.col("fact_id_1") == F.col("__id1"), how).join(two, F.col("fact_id_2") == F.col("__id2"), how)
    return met.drop("__id1", "__id2")


def _fields(name: str) -> dict[str, Column]:
    return {c: F.col(f"{name}.{c}") for c in ("claim_fingerprint", "value", "unit")}


def relationship_id(one: Column, two: Column) -> Column:
    return F.sha2(F.concat_ws("#", F.least(one, two), F.greatest(one, two)), 256)


def _stored(rows: DataFrame, created_at: Column) -> DataFrame:
    made = rows.withColumn("id", relationship_id(F.col("fact_id_1"), F.col("fact_id_2"))).withColumn("created_at", created_at)
    return made.select(*RELATIONSHIP_COLUMNS)


def split_by_rule(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs with both facts and ``corroborated``: whether the deterministic rule settles them."""
    return with_facts(pairs, facts).withColumn("corroborated", J.corroborated(_fields("fact_1"), _fields("fact_2")))


def agreed() -> Column:
    """What a corroborated pair says."""
    period = F.coalesce(F.nullif(F.col("fact_1.temporal_scope"), F.lit("")), F.lit("an unstated period"))
    said = F.concat_ws(" ", "fact_1.subject", "fact_1.attribute", F.lit("is"), "fact_1.value", F.coalesce("fact_1.unit", F.lit("")))
    return F.concat(F.lit("Both sources agree: "), said, F.lit(" for "), period, F.lit("."))


def settle(matched: DataFrame, created_at: Column) -> DataFrame:
    """Relationships of the pairs that the deterministic rule corroborates."""
    rows = matched.where("corroborated").select(
        "fact_id_1", "fact_id_2", "match_source", "is_intra_document",
        F.lit("corroborates").alias("relation_type"),
        F.lit("none").alias("reconciling_factor"),
        agreed().alias("explanation"),
        J.agreement(F.col("fact_1.confidence"), F.col("fact_2.confidence")).alias("agreement_strength"),
    )
    return _stored(rows, created_at)


def judge(matched: DataFrame, judge_plugin, created_at: Column) -> DataFrame:  # noqa: ANN001
    """Relationships of the other pairs, from a judge's replies; pairs without a readable reply give none."""
    open_pairs = matched.where(~F.col("corroborated")).drop("corroborated")
    return from_replies(judge_plugin.replies(open_pairs), created_at)


def from_replies(replies: DataFrame, created_at: Column) -> DataFrame:
    """Relationships from (pair columns, reply)."""
    read = replies.withColumn("__j", llmjson.judgement(F.col("reply"))).where("__j IS NOT NULL")
    relation = J.relation_type(F.col("__j.relation_type"))
    rows = read.select(
        "fact_id_1", "fact_id_2", "match_source", "is_intra_document",
        relation.alias("relation_type"),
        J.reconciling_factor(F.col("__j.reconciling_factor"), relation).alias("reconciling_factor"),
        F.coalesce("__j.explanation", F.lit("")).alias("explanation"),
        F.lit(1.0).alias("agreement_strength"),
    )
    return _stored(rows, created_at)


def judge_and_collect(pairs: DataFrame, facts: DataFrame, judge_plugin, created_at: Column) -> DataFrame:  # noqa: ANN001
    """Relationships of all pairs: by rule where it settles them, by the judge (if there is one) otherwise.

    A judge that is an expression (it has ``judgement()``) is asked in the same pass over the pairs.
    """
    matched = split_by_rule(pairs, facts)
    if judge_plugin is None:
        return settle(matched, created_at)
    if not hasattr(judge_plugin, "judgement"):
        return settle(matched, created_at).unionByName(judge(matched, judge_plugin, created_at))
    read = matched.withColumn("__j", F.when(~F.col("corroborated"), judge_plugin.judgement()))
    relation = F.when(F.col("corroborated"), "corroborates").otherwise(J.relation_type(F.col("__j.relation_type")))
    rows = read.where("corroborated OR __j IS NOT NULL").select(
        "fact_id_1", "fact_id_2", "match_source", "is_intra_document",
        relation.alias("relation_type"),
        F.when(F.col("corroborated"), "none").otherwise(J.reconciling_factor(F.col("__j.reconciling_factor"), relation)).alias("reconciling_factor"),
        F.when(F.col("corroborated"), agreed()).otherwise(F.coalesce("__j.explanation", F.lit(""))).alias("explanation"),
        F.when(F.col("corroborated"), J.agreement(F.col("fact_1.confidence"), F.col("fact_2.confidence"))).otherwise(1.0).alias("agreement_strength"),
    )
    return _stored(rows, created_at)
