"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

1. Corpus frequencies of the benchmark's terms are counted over all documents, and every phrase (a window of ``WINDOW``
   consecutive item words; a shorter item is one window) gets its ``LISTS`` rarest terms with their offsets.
2. The postings of those terms are stored once: term, document key, position. Postings of a phrase's rarest term also
   have the words around the position, as far as phrases of that term reach.
3. The rarest term's list gives places where a phrase can start. Offsets adjusted, they are intersected with the next
   rarest term's list and the one after it, and the whole phrase is compared last.

A term's postings and the phrases that start from it are dealt by the term and a salt, as many salts as its frequency
asks for, so a frequent term is not one task. Documents stand for their text's key. The benchmark's terms are sent to
all tasks in blocks of ``BLOCK_BYTES``: a pass over the corpus for that many different terms, whatever the number and
length of the items.

Defined results: null and wordless texts have no words and are not contaminated; null and wordless items have no
windows; items with a null id are left out. Repeated rows stay repeated, repeated items count once, empty tables give
empty or clean results, other columns are ignored by ``contamination`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, columns, text_key

WINDOW = 13
#: Terms, in bytes, that are sent to all tasks at a time.
BLOCK_BYTES = 4 << 20
#: Position lists of a phrase that are intersected.
LISTS = 3
#: Postings of a term that share a salt.
SALTED = 20_000
#: Contaminated: at least one word in twenty is hit.
SHARE = 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. Where all characters are ASCII that is what ``lower`` does, in less time."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), _SEPARATORS), "")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """phrase (array of words) and the ids of the items that have it."""
    rows = columns(items, item_id="item_id", text="text").where("item_id IS NOT NULL")
    rows = rows.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (window - 1))))
    cut = rows.select("item_id", "ws", starts.alias("i")).select("item_id", F.slice("ws", F.col("i"), window).alias("phrase"))
    return cut.groupBy("phrase").agg(F.collect_set("item_id").alias("items"))


def blocks_of(terms: DataFrame) -> list[DataFrame]:
    """The rows of ``terms`` (with a column term) in blocks of about ``BLOCK_BYTES``."""
    total = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    if n == 1:
        return [terms]
    return [terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i) for i in range(n)]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def with_rarest(found: DataFrame, docs_words: DataFrame, scratch: Scratch) -> DataFrame:
    """Each phrase with a number ``pid`` and ``rare``: its rarest terms in the corpus, with their offsets and frequencies.

    A term the corpus does not have rules its phrase out.
    """
    terms = scratch.write(found.select(F.explode("phrase").alias("term")).distinct(), "terms")
    occurring = docs_words.select(F.explode("ws").alias("term"))
    blocks = blocks_of(terms)
    counted = union([occurring.join(F.broadcast(block), "term").groupBy("term").count() for block in blocks])
    # A row a term: as small as the block, so a frequent benchmark word need not meet its phrases in one task.
    counted = F.broadcast(counted) if len(blocks) == 1 else counted
    placed = found.select("phrase", F.posexplode("phrase").alias("at", "term")).join(counted, "term", "left")
    each = F.struct(F.coalesce("count", F.lit(0)).alias("n"), "at", "term")
    rare = placed.groupBy("phrase").agg(F.slice(F.sort_array(F.collect_list(each)), 1, LISTS).alias("rare"))
    made = found.join(rare.where(F.col("rare")[0]["n"] > 0), "phrase").withColumn("pid", F.monotonically_increasing_id())
    return scratch.write(made, "phrases")


def salts(n: Column) -> Column:
    return F.floor(n / SALTED).cast("int") + 1


def postings(docs: DataFrame, wanted: DataFrame, scratch: Scratch, back: Column, ahead: Column) -> DataFrame:
    """The index of all rarest terms: term, salt, key, n_words, pos (from 0), near (words of the text from near_start).

    ``near`` covers what ``back`` and ``ahead`` ask for around the rarest term of a phrase and is empty for terms that
    are no phrase's rarest. Words are exploded and probed in one stage; only matching positions are copied.
    """
    lead = wanted.select(F.col("rare")[0].alias("r"), back.alias("back"), ahead.alias("ahead"))
    others = wanted.select(F.explode(F.slice("rare", 2, LISTS)).alias("r"), F.lit(None).cast("int").alias("back"), F.lit(None).cast("int").alias("ahead"))
    terms = lead.union(others).groupBy(F.col("r.term").alias("term")).agg(
        F.max("back").alias("back"), F.max("ahead").alias("ahead"), F.max(salts(F.col("r.n"))).alias("salts")
    )
    terms = scratch.write(terms, "rarest")
    words = docs.select(text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("ws"))
    start = F.greatest(F.lit(0), F.col("pos") - F.col("back"))
    near = F.when(F.col("back").isNotNull(), F.slice("ws", start + 1, F.col("pos") - start + 1 + F.col("ahead")))
    parts = []
    for block in blocks_of(terms):
        at = words.select("key", "ws", F.posexplode("ws").alias("pos", "term")).join(F.broadcast(block), "term")
        salt = F.pmod(F.hash("key", "pos"), F.col("salts")).alias("salt")
        parts.append(at.select("term", salt, "key", F.size("ws").alias("n_words"), "pos", start.alias("near_start"), near.alias("near")))
    return scratch.write(union(parts), "postings")


def starts_of(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Places (key, first) where a phrase can start by its rarest term, with the phrase and the words around."""
    lead = F.col("rare")[0]
    asked = wanted.select("pid", "phrase", "rare", lead["term"].alias("term"), lead["at"].alias("offset"), lead["n"].alias("n"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), salts(F.col("n")) - 1)).alias("salt")).drop("n")
    met = index.where("near IS NOT NULL").join(asked, ["term", "salt"]).withColumn("first", F.col("pos") - F.col("offset"))
    return met.where((F.col("first") >= 0) & (F.col("first") + F.size("phrase") <= F.col("n_words")))


def exact_matches(index: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """pid, key, n_words, and the first and next position of every occurrence of a phrase."""
    places = index.select("term", "key", "pos").distinct()
    open_ = starts_of(index, wanted).select("pid", "phrase", "rare", "key", "n_words", "first", "near", "near_start")
    for k in range(1, LISTS):
        listed = F.get("rare", F.lit(k))
        asked = open_.withColumn("term", listed["term"]).withColumn("pos", F.col("first") + listed["at"])
        # Phrases of fewer terms have no such list.
        open_ = asked.where("term IS NOT NULL").join(places, ["term", "key", "pos"], "left_semi").unionByName(asked.where("term IS NULL")).drop("term", "pos")
        open_ = scratch.write(open_, f"lists_{k + 1}")
    whole = F.slice("near", F.col("first") - F.col("near_start") + 1, F.size("phrase")) == F.col("phrase")
    return open_.where(whole).select("pid", "key", "n_words", "first", (F.col("first") + F.size("phrase")).alias("next"))


def hits(docs: DataFrame, items: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """For each text with a hit: key, n_words, n_hit, ids of the items that occur."""
    texts = columns(docs, text="text").select(F.col("text").cast("string").alias("text"))
    found = scratch.write(phrases(items, window), "windows")
    wanted = with_rarest(found, texts.select(words_of(F.col("text")).alias("ws")), scratch)
    offset = F.col("rare")[0]["at"]
    index = postings(texts, wanted.select("phrase", "rare"), scratch, offset, F.size("phrase") - 1 - offset)
    matches = scratch.write(exact_matches(index, wanted, scratch), "matches")
    spans = matches.groupBy("key").agg(F.first("n_words").alias("n_words"), F.sort_array(F.collect_set(F.struct("first", "next"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("until")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["next"] - F.greatest(a["until"], s["first"]))).alias("n"),
            F.greatest(a["until"], s["next"]).alias("until"),
        ),
        lambda a: a["n"],
    )
    named = matches.select("key", "pid").distinct().join(wanted.select("pid", F.explode("items").alias("item")), "pid")
    named = named.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    made = spans.join(named, "key").select("key", "n_words", covered.cast("long").alias("n_hit"), "items")
    return scratch.write(made, "hits")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * SHARE >= n_words)


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids that occur, as strings, sorted), contaminated."""
    found = hits(docs, items, Scratch(spark, "decontaminate"), window).drop("n_words")
    rows = columns(docs, doc_id="doc_id", text="text").select(
        "doc_id",
        text_key(F.col("text").cast("string")).alias("key"),
        F.size(words_of(F.col("text").cast("string"))).cast("long").alias("n_words"),
    )
    out = rows.join(found, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows that are not contaminated, with their columns as they were."""
    found = hits(docs, items, Scratch(spark, "decontaminate"), window)
    bad = found.where(contaminated(F.col("n_hit"), F.col("n_words"))).select("key")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    keyed = plain.withColumn("key", text_key(F.col(f"c{names.index('text')}").cast("string")))
    return keyed.join(bad, "key", "left_anti").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def proximity_matches(spark: SparkSession, docs: DataFrame, queries: DataFrame, reach: int) -> DataFrame:
    """doc_id and item_id where all terms of the item stand within ``reach`` words of one place of its rarest term.

    For short queries; rows with null ids are left out of the queries and kept null in documents. Empty tables give no
    matches.
    """
    scratch = Scratch(spark, "proximity")
    rows = columns(queries, item_id="item_id", text="text").where("item_id IS NOT NULL")
    whole = rows.select("item_id", F.array_sort(F.array_distinct(words_of(F.col("text")))).alias("phrase")).where(F.size("phrase") > 0)
    found = scratch.write(whole.groupBy("phrase").agg(F.collect_set("item_id").alias("items")), "queries")
    texts = columns(docs, doc_id="doc_id", text="text").withColumn("text", F.col("text").cast("string"))
    wanted = with_rarest(found, texts.select(words_of(F.col("text")).alias("ws")), scratch)
    index = postings(texts.select("text"), wanted.select("phrase", "rare"), scratch, F.lit(reach), F.lit(reach))
    lead = F.col("rare")[0]
    asked = wanted.select("phrase", "items", lead["term"].alias("term"), F.explode(F.sequence(F.lit(0), salts(lead["n"]) - 1)).alias("salt"))
    met = index.where("near IS NOT NULL").join(asked, ["term", "salt"]).where(F.size(F.array_intersect("phrase", "near")) == F.size("phrase"))
    found = met.select("key", F.explode("items").alias("item_id")).distinct()
    keyed = texts.select("doc_id", text_key(F.col("text")).alias("key"))
    return keyed.join(scratch.write(found, "found"), "key").select("doc_id", "item_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL),
w AS (
  SELECT DISTINCT item_id, len(v) AS n, array_to_string(v, ' ') AS phrase
  FROM (SELECT item_id, ws[i : i + 12] AS v
        FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM b WHERE len(ws) > 0))),
sizes AS (SELECT DISTINCT n FROM w),
g AS (
  SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS phrase
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
m AS (SELECT r, i, g.n, item_id FROM g JOIN w ON g.phrase = w.phrase AND g.n = w.n),
h AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
t AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
