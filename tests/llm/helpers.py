"""Tables with the awkward cases: nulls in every column, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside themselves, as extra columns.
CLASHES = ["key", "rid", "fp", "task", "rank", "__fp", "__rid", "__base", "spans", "lang_pred", "lang_score", "score", "items", "bucket", "tie"]
WORDS = {
    "en": "the of and river stone window morning never under light garden answer quiet".split(),
    "de": "der und nicht straße fenster immer über größe wieder zwischen müde haus".split(),
    "fr": "le et être fenêtre jamais où façon élève première lumière jardin".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = sentence(rng, lang, rng.randint(1, 120))
        rows.append((i, text, lang, "s", len(text)))
    long = sentence(rng, "en", 12_000)
    rows += [
        (n, None, None, None, None), (None, "the river and the stone", None, None, None), (n + 1, "", "en", "s", 0), (n + 2, " \t\n", "en", "s", 3),
        (n + 3, long, "en", "s", len(long)), (n + 4, long + " end", "en", "s", None), (n + 5, "12 34", "en", "s", 5), (0, rows[0][1], "en", "s", 1), (0, rows[0][1], "en", "s", 1),
        (n + 6, rows[1][1], "fr", "s", 2), (n + 7, "ß ÉÀ 😀 <|endoftext|> x", "de", "s", 3), (None, None, None, None, None),
    ]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS).repartition(3)


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)])
