"""Page scoring, gating and selection as DataFrame transforms.

All windows are partitioned by document, so a page table of any number of documents is spread by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import density
from factloom.functions.normalize import trimmed_page

LEAST_VALID_CHARS = 60
PIPELINE_PAGES = 3
DEFAULT_PAGES = 6
DEFAULT_GATE = 15
PROMPT_CHARS = 2400


def with_table_counts(pages: DataFrame) -> DataFrame:
    """Missing table counts are those of ``tables``, where there is such a column: tables that have rows, and their rows."""
    known = {"table_count": F.lit(0), "table_row_count": F.lit(0)}
    if "tables" in pages.columns:
        filled = F.filter(F.coalesce("tables", F.array().cast(pages.schema["tables"].dataType)), lambda t: F.size(t) > 0)
        known = {"table_count": F.size(filled), "table_row_count": F.aggregate(filled, F.lit(0), lambda n, t: n + F.size(t))}
    given = {c: F.coalesce(F.col(c), n) if c in pages.columns else n for c, n in known.items()}
    return pages.withColumns(given)


def with_density(pages: DataFrame) -> DataFrame:
    """Adds is_front_matter and density_score; blank pages go. Missing table counts are those of ``tables``."""
    tables, rows = F.col("table_count"), F.col("table_row_count")
    text, clean = F.col("text"), F.col("__clean")
    kept = with_table_counts(pages.where(density.not_blank(text))).withColumns({"__clean": trimmed_page(text), "__low": F.lower(text)})
    kept = kept.withColumn("is_front_matter", density.is_front_matter(text, clean))
    scored = kept.withColumn("density_score", density.density_score(text, tables, rows, F.col("is_front_matter"), clean, F.col("__low")))
    return scored.drop("__clean", "__low")


def effective_gate(max_pages: int | None) -> int | None:
    """The page gate of a request: unset means the default, zero or less means none."""
    if max_pages is None:
        return DEFAULT_GATE
    return max_pages if max_pages > 0 else None


def gate(pages: DataFrame, max_pages: int | None) -> DataFrame:
    """The first ``max_pages`` pages of each document; all of them for None."""
    if max_pages is None:
        return pages
    order = Window.partitionBy("doc_id").orderBy("page_number")
    return pages.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= max_pages).drop("__n")


def drop_front_matter(pages: DataFrame) -> DataFrame:
    """Pages with text that are not front matter; all pages of a document that would lose every one."""
    fit = ~F.col("is_front_matter") & density.has_text(F.col("text"))
    kept = pages.withColumn("__fit", fit).withColumn("__any", F.count_if("__fit").over(Window.partitionBy("doc_id")) > 0)
    return kept.where(F.col("__fit") | ~F.col("__any")).drop("__fit", "__any")


def top_pages(pages: DataFrame, k: int = DEFAULT_PAGES) -> DataFrame:
    """The ``k`` densest valid pages of each document, ties to the earlier page.

    Documents with at most ``k`` valid pages keep them all. Front matter competes only where fewer than ``k`` other
    pages are valid.
    """
    doc = Window.partitionBy("doc_id")
    valid = pages.where(F.length(trimmed_page(F.col("text"))) >= LEAST_VALID_CHARS)
    counted = valid.withColumn("__valid", F.count("*").over(doc)).withColumn("__content", F.count_if(~F.col("is_front_matter")).over(doc))
    few = F.col("__valid") <= k
    pool = counted.where(few | ~F.col("is_front_matter") | (F.col("__content") < k))
    rank = F.row_number().over(doc.orderBy(F.desc("density_score"), "page_number"))
    return pool.withColumn("__r", rank).where(few | (F.col("__r") <= k)).drop("__valid", "__content", "__r")


def select_pages(pages: DataFrame, max_pages: int | None, k: int = PIPELINE_PAGES) -> DataFrame:
    """What goes to extraction: gate, front matter out, then the densest pages of documents with more than ``k``."""
    subset = gate(pages, max_pages)
    if max_pages is not None:
        subset = drop_front_matter(subset)
    sized = subset.withColumn("__size", F.count("*").over(Window.partitionBy("doc_id")))
    small = sized.where(F.col("__size") <= k).drop("__size")
    large = top_pages(sized.where(F.col("__size") > k).drop("__size"), k)
    return small.unionByName(large).where(density.has_text(F.col("text")))


def prompt_text(pages: DataFrame) -> DataFrame:
    """The part of a page that an extractor sees."""
    return pages.withColumn("prompt_text", F.left("text", F.lit(PROMPT_CHARS)))
