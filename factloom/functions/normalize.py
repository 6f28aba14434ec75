"""Claim normalisation as Column expressions: names, time scopes, attributes and the claim fingerprint.

Each cascade is one ordered expression, so it stays inside one projection. Characters are classed by Unicode
properties, not by the engine's default word class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. --------------------------------------------------------------------------------------------------------
UNSPECIFIED = "unspecified"
CORPORATE_SUFFIXES = (
    "_limited", "_ltd", "_pvt_ltd", "_private_limited", "_inc", "_incorporated", "_corp", "_corporation", "_llc",
)
QUALIFIER_SUFFIXES = ("_rate", "_ratio", "_total", "_value", "_figure", "_level", "_estimate")
ATTRIBUTE_SYNONYMS = {
    "profit_after_tax": "pat",
    "profit_after_tax_loss": "pat",
    "net_profit": "pat",
    "net_loss": "pat",
    "restated_profit": "pat",
    "restated_loss": "pat",
    "restated_loss_for_the_period": "pat",
    "restated_loss_for_the_year": "pat",
    "restated_profit_loss": "pat",
    "revenue_from_operations": "revenue",
    "total_revenue": "revenue",
    "total_income": "revenue",
    "real_gdp_growth": "gdp_growth",
    "gdp_growth": "gdp_growth",
    "growth_in_real_gdp": "gdp_growth",
    "headline_inflation": "cpi_inflation",
    "cpi_inflation": "cpi_inflation",
    "retail_inflation": "cpi_inflation",
    "gross_fiscal_deficit": "fiscal_deficit",
}
QUARTER = r"(q[1-4])\s*(?:of\s*)?(?:fy\s*)?([0-9]{2,4})"
YEAR_RANGE = r"(?:fy\s*)?([0-9]{4})[-/]([0-9]{2,4})"
FISCAL_YEAR = r"fy\s*([0-9]{2,4})"
CALENDAR_YEAR = r"\b(19[0-9][0-9]|20[0-9][0-9])\b"
# ----------------------------------------------------------------------------------------------------------------------

SPACE = r"[\s\p{Z}]"


def trimmed(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def trimmed_page(text: Column) -> Column:
    """``trimmed`` for a column of long texts: most have no white space at an end and are not searched."""
    outer = F.left(text, F.lit(1)).rlike(SPACE) | F.right(text, F.lit(1)).rlike(SPACE)
    return F.when(outer, trimmed(text)).otherwise(text)


def snake_case(text: Column) -> Column:
    """Lower snake case with at most one corporate suffix taken off; ``unspecified`` if nothing is left."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_\s\p{Z}-]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, r"[\s\p{Z}-]+", "_"), "_+", "_")
    plain = F.lower(F.regexp_replace(joined, "^_+|_+$", ""))
    suffixes = "|".join(s.removeprefix("_") for s in CORPORATE_SUFFIXES)
    # The greedy group leaves the shortest suffix, which is the one that comes first in the list where two fit.
    bare = F.regexp_replace(plain, rf"^(.+)_(?:{suffixes})$", "$1")
    return F.coalesce(F.nullif(F.regexp_replace(bare, "_+$", ""), F.lit("")), F.lit(UNSPECIFIED))


def _century(year: Column, base: Column | int = 2000) -> Column:
    return F.when(year < 100, year + base).otherwise(year)


def temporal_scope(scope: Column) -> Column:
    """Canonical period: ``qN_fyYYYY``, ``fyYYYY``, ``cyYYYY``, or the scope in snake case. The first rule that fits wins."""
    s = F.lower(trimmed(scope))

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(s, pattern, group).try_cast("int")

    start, end = number(YEAR_RANGE, 1), number(YEAR_RANGE, 2)
    century = (F.floor(start / 100) * 100).cast("int")
    return (
        F.when(scope.isNull() | (scope == ""), F.lit(UNSPECIFIED))
        .when(s.rlike(QUARTER), F.concat(F.regexp_extract(s, QUARTER, 1), F.lit("_fy"), _century(number(QUARTER, 2)).cast("string")))
        .when(s.rlike(YEAR_RANGE), F.concat(F.lit("fy"), _century(end, century).cast("string")))
        .when(s.rlike(FISCAL_YEAR), F.concat(F.lit("fy"), _century(number(FISCAL_YEAR, 1)).cast("string")))
        .when(s.rlike(CALENDAR_YEAR), F.concat(F.lit("cy"), F.regexp_extract(s, CALENDAR_YEAR, 1)))
        .otherwise(snake_case(s))
    )


def attribute_name(attribute: Column) -> Column:
    """Snake case, one qualifier off where four characters or more stay, then the synonym's canonical name."""
    suffixes = "|".join(s.removeprefix("_") for s in QUALIFIER_SUFFIXES)
    bare = F.regexp_replace(snake_case(attribute), rf"^(.{{4,}})_(?:{suffixes})$", "$1")
    table = F.create_map(*[F.lit(x) for pair in ATTRIBUTE_SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, bare), bare)


def claim_fingerprint(subject: Column, attribute: Column, scope: Column) -> Column:
    """``subject::attribute::scope`` of already normalised names and a raw scope."""
    return F.concat_ws("::", snake_case(subject), attribute_name(attribute), temporal_scope(scope))
