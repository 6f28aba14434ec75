"""Reading a model's replies: a ladder from strict JSON down to single objects and single fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.normalize import trimmed

# Fixed values. --------------------------------------------------------------------------------------------------------
FENCE = r"```(?:json)?\s*([\s\S]*?)\s*```"
FACT_OBJECT = r'\{[^{}]*"subject"[^{}]*\}'
#: What may close a reply that was cut off, in the order tried; the last is the text up to its last brace.
FACT_CLOSERS = ("]}", "}", "]", "")
JUDGE_CLOSERS = ("]}", "}", '"}')
NO_EXPLANATION = "Extracted relationship."
# ----------------------------------------------------------------------------------------------------------------------

FACT = (
    "struct<subject:string,attribute:string,value:string,unit:string,temporal_scope:string,conditions:string,"
    "evidence_quote:string,confidence:string,subject_normalized:string,attribute_normalized:string,extraction_group_id:string>"
)
JUDGEMENT = "struct<relation_type:string,reconciling_factor:string,explanation:string>"


def body(raw: Column) -> Column:
    """The text inside a code fence if there is one."""
    text = trimmed(F.coalesce(raw, F.lit("")))
    return F.when(text.rlike(FENCE), trimmed(F.regexp_extract(text, FENCE, 1))).otherwise(text)


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else.

    The parser stops at the end of the first value, so the text is tried as a member with another member after it.
    """
    framed = F.concat(F.lit('{"a":'), text, F.lit(',"b":1}'))
    return F.coalesce(F.try_variant_get(F.try_parse_json(framed), "$.b", "int") == 1, F.lit(False))


def first_valid(text: Column, closers: tuple[str, ...]) -> Column:
    """The text, or the text up to its last brace with a closer, whichever first is JSON; else null."""
    cut = F.regexp_extract(text, r"^([\s\S]*\})", 1)
    tries = [F.concat(cut, F.lit(c)) for c in closers]
    return F.coalesce(
        F.when(is_json(text) & text.rlike(r"^\s*[\[{]"), text), *[F.when((cut != "") & is_json(t), t) for t in tries]
    )


def reply_facts(raw: Column) -> Column:
    """array<FACT> of an extraction reply: an object with ``facts``, a bare list, or the flat objects found in it."""
    text = body(raw)
    whole = first_valid(text, FACT_CLOSERS)
    listed = F.when(whole.rlike(r"^\s*\["), F.from_json(whole, f"array<{FACT}>")).otherwise(
        F.from_json(whole, f"struct<facts:array<{FACT}>>")["facts"]
    )
    loose = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(FACT_OBJECT), F.lit(0)), lambda o: F.from_json(o, FACT)),
        lambda o: o["subject"].isNotNull() & o["value"].isNotNull(),
    )
    none = F.array().cast(f"array<{FACT}>")
    return F.when(whole.isNotNull(), F.coalesce(listed, none)).otherwise(F.coalesce(loose, none))


def explode_facts(replies: DataFrame, raw: str) -> DataFrame:
    """One row per fact of each reply, with the reply's other columns."""
    keep = [c for c in replies.columns if c != raw]
    return replies.select(*keep, F.posexplode(reply_facts(F.col(raw))).alias("fact_no", "fact")).select(*keep, "fact_no", "fact.*")


def _field(text: Column, name: str, closed: bool = True) -> Column:
    return F.nullif(F.regexp_extract(text, rf'(?i)"{name}"\s*:\s*"([^"]+)' + ('"' if closed else ""), 1), F.lit(""))


def judgement(raw: Column) -> Column:
    """The JUDGEMENT of a judge's reply; null when no relation can be read."""
    text = body(raw)
    whole = F.from_json(first_valid(text, JUDGE_CLOSERS), JUDGEMENT)
    loose = F.when(
        _field(text, "relation_type").isNotNull(),
        F.struct(
            _field(text, "relation_type").alias("relation_type"),
            F.coalesce(_field(text, "reconciling_factor"), F.lit("none")).alias("reconciling_factor"),
            F.coalesce(_field(text, "explanation", closed=False), F.lit(NO_EXPLANATION)).alias("explanation"),
        ),
    )
    return F.coalesce(whole, loose)
