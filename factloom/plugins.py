"""The two places where a model may be plugged in, with offline implementations.

An extractor turns pages into replies; a judge turns pairs into replies. Replies are JSON text that ``llmjson`` reads.
Network clients belong behind ``PromptExtractor`` and ``PromptJudge``: they take a function from a prompt to a reply and
call it in ``mapInPandas`` after all filters and limits, since Spark moves no filter below that point. The function
must be idempotent, because a task can run again; it is called up to ``tries`` times with growing delays.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.pages import prompt_text


class FactExtractor(Protocol):
    def replies(self, pages: DataFrame) -> DataFrame:
        """``pages`` (doc_id, doc_name, page_number, text) with a column ``reply``."""


class RelationJudge(Protocol):
    def replies(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (with the structs fact_1 and fact_2) with a column ``reply``."""


def extraction_prompt(pages: DataFrame) -> DataFrame:
    """Adds ``prompt``: where the text is from, the text, and what is asked."""
    head = F.concat(F.lit("Document: "), F.col("doc_name"), F.lit("\nPage: "), F.col("page_number").cast("string"), F.lit("\n\n"))
    ask = F.lit('\n\nList the quantitative facts of this page as JSON, {"facts": [...]}, each with a verbatim evidence_quote.')
    return prompt_text(pages).withColumn("prompt", F.concat(head, F.col("prompt_text"), ask)).drop("prompt_text")


def pair_prompt(pairs: DataFrame) -> DataFrame:
    """Adds ``prompt``: both facts field by field, the hint, and what is asked; missing fields have plain defaults."""

    def fact(name: str) -> list:
        def part(label: str, column: str, default: str = "") -> list:
            return [F.lit(f"\n{label}: "), F.coalesce(F.nullif(F.col(f"{name}.{column}").cast("string"), F.lit("")), F.lit(default))]

        return [
            *part("Source", "source_doc"), *part("Page", "page"), *part("Subject", "subject"), *part("Normalised subject", "subject_normalized"),
            *part("Attribute", "attribute"), *part("Normalised attribute", "attribute_normalized"), *part("Value", "value"), *part("Unit", "unit"),
            *part("Period", "temporal_scope", "unspecified"), *part("Conditions", "conditions", "none"), *part("Quote", "evidence_quote"),
        ]

    hint = F.coalesce(F.col("match_hint"), F.lit("none")) if "match_hint" in pairs.columns else F.lit("none")
    ask = F.lit('\n\nAnswer as JSON with relation_type, reconciling_factor and explanation.')
    return pairs.withColumn("prompt", F.concat(F.lit("Fact 1"), *fact("fact_1"), F.lit("\n\nFact 2"), *fact("fact_2"), F.lit("\n\nHint: "), hint, ask))


# Fixed values. --------------------------------------------------------------------------------------------------------
LIMIT_MARKS = ("429", "quota", "rate limit", "resource_exhausted")
ASKED_WAIT = r"try again in ([0-9.]+)s"
TRIES, PAUSE, EXTRA_WAIT = 4, 3.0, 1.0
# ----------------------------------------------------------------------------------------------------------------------


def attempting(call: Callable[[str], str], tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str | None, str | None]]:
    """(reply, error) of ``call`` with retries on rate limits: the pause grows, or is what the error asks for and a
    second more. A reply that can't be had is None, with the last error."""

    def run(prompt: str) -> tuple[str | None, str | None]:
        said = ""
        for attempt in range(tries):
            try:
                return call(prompt), None
            except Exception as e:  # a model's client may raise anything
                said = str(e)
                if attempt + 1 == tries or not any(x in said.lower() for x in LIMIT_MARKS):
                    break
                asked = re.search(ASKED_WAIT, said.lower())
                sleep(max(pause * (attempt + 1), float(asked[1]) + EXTRA_WAIT if asked else 0.0))
        return None, said

    return run


def retrying(call: Callable[[str], str], tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """The reply alone."""
    run = attempting(call, tries, pause, sleep)
    return lambda prompt: run(prompt)[0]


def _ask(rows: DataFrame, call: Callable[[str], tuple[str | None, str | None]]) -> DataFrame:
    """__id, reply and error of each prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [call(p) for p in batch["prompt"]]
            yield pd.DataFrame({"__id": batch["__id"], "reply": [r for r, _ in made], "error": [e for _, e in made]})

    return rows.mapInPandas(run, "__id string, reply string, error string")


class PromptExtractor:
    """Calls a function with each page's prompt; ``error`` says why a reply is missing."""

    def __init__(self, call: Callable[[str], str]):
        self.call = attempting(call)

    def replies(self, pages: DataFrame) -> DataFrame:
        keyed = extraction_prompt(pages).withColumn("__id", F.concat_ws("\x1f", "doc_id", F.col("page_number").cast("string")))
        asked = _ask(keyed.select("__id", "prompt"), self.call)
        return keyed.drop("prompt").join(asked, "__id").drop("__id")


class PromptJudge:
    """Calls a function with each pair's prompt; ``error`` says why a reply is missing."""

    def __init__(self, call: Callable[[str], str]):
        self.call = attempting(call)

    def replies(self, pairs: DataFrame) -> DataFrame:
        keyed = pair_prompt(pairs).withColumn("__id", F.concat_ws("\x1f", "fact_id_1", "fact_id_2"))
        asked = _ask(keyed.select("__id", "prompt"), self.call)
        return keyed.drop("prompt").join(asked, "__id").drop("__id")


class ReplayExtractor:
    """Recorded replies by document and page."""

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded.select("doc_id", "page_number", "reply")

    def replies(self, pages: DataFrame) -> DataFrame:
        return pages.join(self.recorded, ["doc_id", "page_number"])


class RuleJudge:
    """Judges by rule, in SQL expressions: other period, other unit, rounding, or contradiction."""

    def judgement(self) -> Column:
        """The judgement as an expression over fact_1 and fact_2: a struct, so nothing is written to text and parsed."""
        one, two = F.split(F.col("fact_1.claim_fingerprint"), "::"), F.split(F.col("fact_2.claim_fingerprint"), "::")
        a, b = (F.replace(F.trim(F.col(f"{n}.value")), F.lit(","), F.lit("")).try_cast("double") for n in ("fact_1", "fact_2"))
        units = [F.lower(F.trim(F.coalesce(F.col(f"{n}.unit"), F.lit("")))) for n in ("fact_1", "fact_2")]
        factor = (
            F.when(F.element_at(one, -1) != F.element_at(two, -1), "temporal_scope")
            .when(F.element_at(one, 1) != F.element_at(two, 1), "entity_scope")
            .when((units[0] != units[1]) & (units[0] != "") & (units[1] != ""), "unit_difference")
            .when(F.element_at(one, 2) != F.element_at(two, 2), "definition_difference")
            .when(F.round(a) == F.round(b), "precision_or_rounding")
        )
        relation = (
            F.when(F.lower(F.trim("fact_1.value")) == F.lower(F.trim("fact_2.value")), "corroborates")
            .when(factor.isNotNull(), "reconciled")
            .otherwise("contradicts")
        )
        return F.struct(
            relation.alias("relation_type"),
            F.coalesce(factor, F.lit("none")).alias("reconciling_factor"),
            F.concat(F.lit("By rule: "), relation).alias("explanation"),
        )

    def replies(self, pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("reply", F.to_json(self.judgement()))
