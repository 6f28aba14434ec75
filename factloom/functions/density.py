"""Information density of a page and the front-matter test, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.normalize import trimmed_page

# Fixed values. --------------------------------------------------------------------------------------------------------
LEAST_CHARS = 50
HEADER_LINES = 6
FRONT_MATTER_PHRASES = (
    "table of contents", "contents\t", "contents\n", "abbreviations", "list of tables", "list of boxes", "preface",
    "acknowledgement",
)
DOTS, MANY_DOTS = "...", 8
SPACED_DOTS, MANY_SPACED_DOTS = ". . .", 4
NUMBER = r"\b[0-9]+(?:\.[0-9]+)?%?\b"
METRIC_TOKENS = (
    "%", "₹", r"\$", "€", "crore", "million", "billion", "trillion", "ratio", "bps", "growth", "deficit", "revenue",
    "profit", "loss", "gdp", "inflation", "pat", "ebitda", "cpi",
)
CORE_METRICS = (
    "revenue", "profit", "loss", "pat", "pbt", "ebitda", "gdp", "gva", "cpi", "wpi", "inflation", "growth", "deficit",
    "net worth", "assets", "liabilities", "borrowings",
)
DIGIT_WEIGHT, TABLE_LINE_WEIGHT, METRIC_WEIGHT = 35.0, 30.0, 20.0
TABLE_POINTS, MOST_TABLE_POINTS = 5.0, 15.0
ROW_POINTS, MOST_ROW_POINTS = 0.5, 10.0
CORE_POINTS, MOST_CORE_POINTS = 2.5, 25.0
FRONT_MATTER_FACTOR = 0.05
# ----------------------------------------------------------------------------------------------------------------------



def _alternatives(words: tuple[str, ...]) -> str:
    """A pattern for any of the words, grouped by first letter, so that most places are passed over at once.

    No word is the start of another one, so the order of the words does not matter.
    """
    firsts = dict.fromkeys(w[: 2 if w[0] == "\\" else 1] for w in words)
    return "|".join(f"{f}(?:{'|'.join(w.removeprefix(f) for w in words if w.startswith(f))})" for f in firsts)


#: For texts in lower case.
METRIC_PATTERN = _alternatives(METRIC_TOKENS)
CORE_PATTERN = rf"\b(?:{_alternatives(CORE_METRICS)})\b"
SPACE = r"[\s\p{Z}]"


def count_words(low: Column, words: tuple[str, ...], pattern: str) -> Column:
    """Matches of a pattern of words in a text in lower case; only texts that have one of the words are searched."""
    some = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.removeprefix("\\"))) for w in words])
    return F.when(some, F.regexp_count(low, F.lit(pattern))).otherwise(0)


def _occurrences(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def has_text(text: Column) -> Column:
    return F.coalesce(F.length(trimmed_page(text)) >= LEAST_CHARS, F.lit(False))


def not_blank(text: Column) -> Column:
    """Stops at the first character that is no white space."""
    return F.coalesce(text.rlike(r"[^\s\p{Z}]"), F.lit(False))


def is_front_matter(text: Column, clean: Column | None = None) -> Column:
    """Contents pages and the like, by phrases in the first lines or by dot leaders.

    ``clean`` is the trimmed text, where a plan has it already.
    """
    clean = trimmed_page(text) if clean is None else clean
    head = F.lower(F.substring_index(clean, "\n", HEADER_LINES))
    found = F.lit(False)
    for phrase in FRONT_MATTER_PHRASES:
        found = found | F.contains(head, F.lit(phrase))
    dotted = (_occurrences(text, DOTS) > MANY_DOTS) | (_occurrences(text, SPACED_DOTS) > MANY_SPACED_DOTS)
    return F.coalesce(F.length(clean) >= LEAST_CHARS, F.lit(False)) & (found | dotted)


def density_score(
    text: Column, tables: Column, table_rows: Column, front_matter: Column, clean: Column | None = None, low: Column | None = None
) -> Column:
    """Weighted shares of digits, table-like lines and metric words, rounded half up to two places.

    ``clean`` and ``low`` are the text trimmed and in lower case, where a plan has them already.
    """
    clean = trimmed_page(text) if clean is None else clean
    n = F.size(F.array_remove(F.split(text, SPACE + "+"), ""))
    lines, low = F.split(clean, "\n"), F.lower(text) if low is None else low
    # A match goes from the first digit of a word to its end; texts without digits are not searched.
    numbers = F.when(text.rlike("[0-9]"), F.regexp_count(text, F.lit(r"[0-9][^\s\p{Z}]*+"))).otherwise(0)
    digits = numbers / n
    tables_like = F.size(F.filter(lines, lambda line: line.rlike("[0-9]") & (F.regexp_count(line, F.lit(NUMBER)) >= 2)))
    tabular = F.when(text.rlike("[0-9]"), tables_like).otherwise(0) / F.size(lines)
    metrics = count_words(low, METRIC_TOKENS, METRIC_PATTERN) / n
    score = (
        digits * DIGIT_WEIGHT
        + tabular * TABLE_LINE_WEIGHT
        + metrics * METRIC_WEIGHT
        + F.least(F.lit(MOST_TABLE_POINTS), tables * TABLE_POINTS)
        + F.least(F.lit(MOST_ROW_POINTS), table_rows * ROW_POINTS)
        + F.least(F.lit(MOST_CORE_POINTS), count_words(low, CORE_METRICS, CORE_PATTERN) * CORE_POINTS)
    )
    score = F.when(front_matter, score * FRONT_MATTER_FACTOR).otherwise(score)
    return F.when(F.coalesce(F.length(clean) >= LEAST_CHARS, F.lit(False)), F.floor(score * 100 + 0.5) / 100).otherwise(F.lit(0.0))
