"""Pair-level rules: relatedness, deterministic corroboration, label and factor normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.normalize import trimmed

# Fixed values. --------------------------------------------------------------------------------------------------------
STOP_WORDS = (
    "of", "in", "the", "and", "to", "for", "a", "an", "on", "as", "by", "at", "per", "from", "with",
    "average", "total", "net", "gross", "daily", "annual", "monthly", "quarterly",
    "number", "numbers", "share", "shares", "period", "year", "quarter", "value", "figure", "level", "rate", "ratio",
)
LONG_WORD = 4
RELATION_TYPES = ("corroborates", "contradicts", "reconciled")
RELATION_STEMS = {"corr": "corroborates", "cont": "contradicts", "rec": "reconciled"}
FACTOR_STEMS = {
    "projection_vs_actual": ("proj", "forecast", "target", "actual"),
    "reporting_basis": ("restate", "basis", "consol", "standalone"),
    "precision_or_rounding": ("round", "precis", "decimal"),
    "temporal_scope": ("temp", "time", "period", "year", "quarter"),
    "entity_scope": ("entity", "scope", "subsidiary"),
    "unit_difference": ("unit", "curr", "scale"),
    "definition_difference": ("def", "gaap", "adjusted", "standard"),
}
ABSOLUTE_TOLERANCE, RELATIVE_TOLERANCE, CONVERTED_TOLERANCE = 1.0, 0.005, 0.01
MILLIONS_PER_CRORE = 10.0
MILLION_STEMS, CRORE_STEMS = ("million", "mn"), ("crore", "cr")
# ----------------------------------------------------------------------------------------------------------------------

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def attribute_words(attribute: Column) -> Column:
    """The distinct content words of an attribute."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(attribute), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def words_related(a: Column, b: Column) -> Column:
    """A long word in common, or any two words."""
    common = F.array_intersect(a, b)
    return F.exists(common, lambda w: F.length(w) >= LONG_WORD) | (F.size(common) >= 2)


def attributes_related(a: Column, b: Column) -> Column:
    return words_related(attribute_words(a), attribute_words(b))


def subjects_related(a: Column, b: Column) -> Column:
    """Equal; or, when both have four characters or more, one within the other or a long part in common."""
    common = F.array_intersect(F.split(a, "_"), F.split(b, "_"))
    close = F.contains(a, b) | F.contains(b, a) | F.exists(common, lambda w: F.length(w) >= LONG_WORD)
    return (a != "") & (b != "") & ((a == b) | ((F.length(a) >= LONG_WORD) & (F.length(b) >= LONG_WORD) & close))


def siblings(a: Column, b: Column) -> Column:
    """Both from one extraction group."""
    return F.coalesce((a != "") & (a == b), F.lit(False))


def corroborated(one: dict[str, Column], two: dict[str, Column]) -> Column:
    """Same claim and, within tolerance or unit conversion, the same value (true or false).

    ``one`` and ``two`` have claim_fingerprint, value and unit. The first branch that holds decides: equal strings;
    numbers that are close; millions against crores; crores against millions.
    """
    f1, f2 = one["claim_fingerprint"], two["claim_fingerprint"]
    v1, v2 = (F.replace(F.lower(trimmed(x["value"])), F.lit(","), F.lit("")) for x in (one, two))
    u1, u2 = (F.lower(trimmed(F.coalesce(x["unit"], F.lit("")))) for x in (one, two))
    units = (
        (u1 == "") | (u2 == "") | (u1 == u2)
        | (F.contains(u1, F.lit("million")) & F.contains(u2, F.lit("million")))
        | (F.contains(u1, F.lit("crore")) & F.contains(u2, F.lit("crore")))
    )
    a, b = (F.when(v.rlike(NUMBER), v).try_cast("double") for v in (v1, v2))

    def close(x: Column, y: Column, base: Column, share: float) -> Column:
        return (F.abs(x - y) <= ABSOLUTE_TOLERANCE) | ((base > 0) & (F.try_divide(F.abs(x - y), base) < share))

    near = close(a, b, F.abs(a), RELATIVE_TOLERANCE)
    to_crore = contains_any(u1, MILLION_STEMS) & contains_any(u2, CRORE_STEMS)
    from_crore = contains_any(u1, CRORE_STEMS) & contains_any(u2, MILLION_STEMS)
    x, y = a / MILLIONS_PER_CRORE, b / MILLIONS_PER_CRORE
    same = (
        F.when(v1 == v2, units)
        .when(a.isNull() | b.isNull(), F.lit(False))
        .when(near, units)
        .when(to_crore, close(x, b, b, CONVERTED_TOLERANCE))
        .when(from_crore, close(a, y, y, CONVERTED_TOLERANCE))
        .otherwise(F.lit(False))
    )
    return F.coalesce((f1 != "") & (f1 == f2) & same, F.lit(False))


def agreement(c1: Column, c2: Column) -> Column:
    """The lower confidence, rounded half up to two places."""
    return F.floor(F.least(c1, c2) * 100 + 0.5) / 100


def relation_type(raw: Column) -> Column:
    """One of ``RELATION_TYPES``; corroborates when nothing fits."""
    t = F.lower(trimmed(F.coalesce(raw, F.lit(""))))
    (first, value), *rest = RELATION_STEMS.items()
    out = F.when(F.contains(t, F.lit(first)), value)
    for stem, value in rest:
        out = out.when(F.contains(t, F.lit(stem)), value)
    return out.otherwise(RELATION_TYPES[0])


def reconciling_factor(raw: Column, relation: Column) -> Column:
    """The factor of a reconciled pair, by the first stem that occurs; ``none`` for the rest."""
    f = F.lower(trimmed(F.coalesce(raw, F.lit(""))))
    out = F.when(relation != "reconciled", "none")
    for factor, stems in FACTOR_STEMS.items():
        out = out.when(contains_any(f, stems), factor)
    return out.otherwise("none")
