"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.decontaminate import OP8_SQL, op8_decontaminate
from factloom.llm.fingerprints import op1_fingerprints
from factloom.llm.html import op9_html
from factloom.llm.language import op7_language
from factloom.llm.packing import op4_pack
from factloom.llm.pii import op5_pii
from factloom.llm.quality import op6_quality
from factloom.llm.simhash import op2_simhash
from factloom.llm.substrings import op10_substrings
from factloom.llm.tokencount import op3_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_simhash": op2_simhash,
    "op3_token_counts": op3_token_counts,
    "op4_pack": op4_pack,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_decontaminate": op8_decontaminate,
    "op9_html": op9_html,
    "op10_substrings": op10_substrings,
}
ORACLES: dict[str, str] = {"op8_decontaminate": OP8_SQL}
