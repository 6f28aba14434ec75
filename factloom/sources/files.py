"""Finding document files, page tables, and layout-aware text from word boxes.

No PDF library is assumed: page text comes from a page table (``PAGES``) or from a reader function that the caller
passes. Word boxes are assembled per page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.schemas import PAGES

LINE_TOLERANCE = 3.5


def find_files(spark: SparkSession, root: str) -> DataFrame:
    """Files ``<root>/<category>/<name>.pdf``: key, title, category, filename, path, length.

    Hidden categories and empty files are left out; of files with one key the last by path stays.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    part = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(part, -1), r"(?i)\.pdf$", "")
    words = F.initcap(F.replace(stem, F.lit("-"), F.lit(" ")))
    rows = found.where("length > 0").select(
        F.replace(stem, F.lit("-"), F.lit("_")).alias("key"),
        F.regexp_replace(words, "^[0-9 ]+", "").alias("title"),
        F.initcap(F.replace(F.element_at(part, -2), F.lit("-"), F.lit(" "))).alias("category"),
        F.element_at(part, -1).alias("filename"),
        "path",
        "length",
    )
    return rows.where("category NOT LIKE '.%'").groupBy("key").agg(F.max_by(F.struct("title", "category", "filename", "path", "length"), "path").alias("f")).select("key", "f.*")


def attempted_pages(files: DataFrame, reader: Callable[[bytes, str], list[dict]]) -> DataFrame:
    """Page rows of binary files (path, content), and ``error``. ``reader`` gives a file's pages as dictionaries of
    page_number, text, table_count and table_row_count; a file for which it raises a ValueError is one row that says so."""
    names = [*(c.split()[0] for c in PAGES.split(", ")), "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                file = {"doc_id": path, "doc_name": path.rsplit("/", 1)[-1], "tables": None, "error": None}
                try:
                    pages = reader(bytes(content), file["doc_name"])
                except ValueError as e:
                    pages = [{"page_number": None, "text": None, "error": str(e)}]
                rows += [file | {"table_count": None, "table_row_count": None} | p for p in pages]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return files.select("path", "content").mapInPandas(run, f"{PAGES}, error string")


def read_pages(files: DataFrame, reader: Callable[[bytes, str], list[dict]]) -> DataFrame:
    """The pages of the files that can be read; ``unreadable`` has the others."""
    return attempted_pages(files, reader).where("error IS NULL").drop("error")


def unreadable(files: DataFrame, reader: Callable[[bytes, str], list[dict]]) -> DataFrame:
    """doc_id, doc_name and error of the files that can't be read."""
    return attempted_pages(files, reader).where("error IS NOT NULL").select("doc_id", "doc_name", "error")


def assemble_lines(words: list[tuple[float, float, float, float, str]]) -> str:
    """Text of a page from words (x0, y0, x1, y1, text) in reading order of the source.

    A word joins the first line whose height is within ``LINE_TOLERANCE`` of its own; lines go from the top, words from
    the left.
    """
    heights: list[float] = []
    lines: list[list[tuple[float, str]]] = []
    for x0, y0, _, y1, text in words:
        middle = (y0 + y1) / 2
        at = next((i for i, h in enumerate(heights) if abs(middle - h) <= LINE_TOLERANCE), len(lines))
        if at == len(lines):
            heights.append(middle)
            lines.append([])
        lines[at].append((x0, text))
    joined = (" ".join(t for _, t in sorted(lines[i], key=lambda w: w[0])).strip() for i in sorted(range(len(lines)), key=heights.__getitem__))
    return "\n".join(line for line in joined if line).strip()


def layout_text(words: DataFrame) -> DataFrame:
    """doc_id, page_number, text from word rows (doc_id, page_number, word_no, x0, y0, x1, y1, word), a group a page."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_no")
        text = assemble_lines(list(zip(pdf.x0, pdf.y0, pdf.x1, pdf.y1, pdf.word, strict=True)))
        return pd.DataFrame({"doc_id": [pdf.doc_id.iloc[0]], "page_number": [pdf.page_number.iloc[0]], "text": [text]})

    return words.groupBy("doc_id", "page_number").applyInPandas(page, "doc_id string, page_number int, text string")
