"""Document fingerprints: a bottom-k sketch of shingle hashes, in DataFrame functions only.

A text's shingles are its runs of ``SHINGLE`` words (lower case, split at white space; a shorter text is one shingle, a
text without words has none). Each is hashed to ``BITS`` bits and the ``K`` smallest different hashes are the sketch.
Sketches of parts merge into the sketch of the whole, and tell resemblance, containment and the number of different
shingles; all three are exact while a text has at most ``K`` shingles.

Defined results: null, empty and blank texts have the empty sketch, which is wholly like another empty one and unlike
any other. Repeated rows stay repeated, an empty table gives an empty result, other columns are ignored by the query.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import columns

SHINGLE = 5
K = 128
BITS = 48


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<long>: the ``k`` smallest different shingle hashes, ascending.

    The words are bound to a lambda's variable, so they are split once a text.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")

    def of(ws: Column) -> Column:
        places = F.when(F.size(ws) == 0, F.array().cast("array<int>")).otherwise(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws) - (shingle - 1)))
        )
        hashes = F.transform(places, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(ws, i, shingle)), 64 - BITS))
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)

    return F.transform(F.array(words), of)[0]


def union_sketch(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both shingle sets together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all (0 to 1); 1 for two empty sketches."""
    both = union_sketch(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles."""
    full = F.lit(float(k - 1)) * F.lit(float(1 << BITS)) / (F.element_at(a, -1) + 1)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(full)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    all_ = distinct_shingles(union_sketch(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), resemblance(a, b, k) * all_ / distinct_shingles(a, k))
    )


def merge(parts: DataFrame, key: str, sketch_col: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts.

    Ranks within (key, salt) first and then within the key, each limited before the rows move, so a key with very
    many parts costs a task at most ``k`` rows from each other task.
    """
    hashes = parts.select(F.col(key).alias("key"), F.explode_outer(sketch_col).alias("h")).distinct()
    first = Window.partitionBy("key", F.pmod(F.col("h"), F.lit(64))).orderBy("h")
    kept = hashes.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    last = Window.partitionBy("key").orderBy("h")
    kept = kept.withColumn("r", F.row_number().over(last)).where(F.col("r") <= k)
    return kept.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("sketch")).select(F.col("key").alias(key), "sketch")


def text_of(sketch_col: Column) -> Column:
    """A sketch as a string: its hashes in hexadecimal, one after another."""
    digits = BITS // 4
    return F.array_join(F.transform(sketch_col, lambda h: F.lower(F.lpad(F.hex(h), digits, "0"))), "")


#: Bytes of text that a bucket of neighbouring rows should have, and the most buckets that a plan names.
BUCKET_BYTES = 32 << 20
MOST_BUCKETS = 50_000
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def cuts_of(quantiles: list[int]) -> list[tuple[int, int]]:
    """Cuts (doc_id, tie), descending, from ascending quantiles of doc_id.

    An id that is m quantiles has at least m - 1 buckets' rows: its range of ties is cut in m.
    """
    cuts = []
    for i, m in Counter(quantiles).items():
        cuts += [(i, _LEAST + j * ((_MOST - _LEAST) // m)) for j in range(m)]
    return sorted(cuts, reverse=True)


def with_next(rows: DataFrame, carried: list[str], least_buckets: int) -> DataFrame:
    """``rows`` (doc_id, tie, text, ...) with ``next_<c>`` of the following row by descending (doc_id, tie); the last is
    followed by the first.

    Rows are dealt by quantiles of doc_id, as many as their bytes ask for, and inside an id that many rows repeat by
    ranges of ``tie``, a hash of the text. A bucket's first row also visits the bucket before it as a guest; only ids, at
    most one a bucket, reach the driver. Null ids come last.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(least_buckets, size // BUCKET_BYTES))
    found = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000 + 10 * buckets)).first()[0]
    cuts = cuts_of(found or [])
    wide = max(1, int(len(cuts) ** 0.5))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]).cast("array<long>")
    pairs = lambda cs: F.arrays_zip(longs([c for c, _ in cs]).alias("id"), longs([t for _, t in cs]).alias("tie"))
    above = lambda c: (c["id"] > F.col("doc_id")) | (c["id"] == F.col("doc_id")) & (c["tie"] > F.col("tie"))
    # Cuts descend: the bucket is the number of cuts above the row, found among every wide-th cut, then among the rest.
    coarse = F.size(F.filter(pairs(cuts[wide - 1 :: wide]), above))
    fine = F.size(F.filter(F.slice(pairs(cuts), coarse * wide + 1, wide), above))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(coarse * wide + fine)
    dealt = rows.withColumn("bucket", bucket)
    firsts = {
        r["bucket"]: r["f"]
        for r in dealt.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("f")).collect()
    }
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    at = F.col("bucket") + 1
    every = range(len(cuts) + 2)
    first_tie = F.element_at(longs([firsts[b]["tie"] if b in firsts else 0 for b in every]), at)
    first_id = F.element_at(longs([firsts[b]["doc_id"] if b in firsts else None for b in every]), at)
    visits = F.element_at(longs([before.get(b, 0) for b in every]), at)
    is_first = F.col("doc_id").eqNullSafe(first_id) & (F.col("tie") == first_tie)
    home = F.struct(F.col("bucket").cast("long").alias("b"), F.lit(False).alias("guest"))
    places = F.when(is_first, F.array(home, F.struct(visits.alias("b"), F.lit(True).alias("guest")))).otherwise(F.array(home))
    seats = dealt.select("doc_id", "tie", *carried, F.inline(places))
    order = Window.partitionBy("b").orderBy("guest", F.desc("doc_id"), F.desc("tie"))
    return seats.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where("NOT guest").drop("b", "guest")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text and sketch of every row."""
    rows = columns(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("sketch", sketch(F.col("text"), k))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = fingerprints(docs).withColumn("tie", F.xxhash64("text"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = with_next(rows, ["text", "sketch"], buckets).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", 1, F.length("text") - half), F.substring("next_text", 1, half))
    made = pairs.select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("edited"))
    made = made.withColumn("edited_sketch", sketch(F.col("edited")))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_of(F.col("sketch")).alias("fingerprint"),
        text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_in_edited"),
    )
