"""SimHash near-duplicates through a Gray-order hierarchical index.

1. One pass makes a 64-bit fingerprint of each whole text; (doc_id, fingerprint) is written to the shared folder.
2. Only distinct fingerprints go on, so a group of copies is one row however large it is.
3. Two fingerprints with at most 2 differing bits agree on one of three blocks of bits. Each fingerprint goes to three
   partitions, by block and the block's value. Values shared by very many fingerprints are split by the remaining bits
   in the same way, as often as need be, which loses no pair.
4. A task sorts its fingerprints by Gray rank, with the block's bits first, and builds a tree over runs of that order:
   a node holds the mask and pattern of the bits that all below it share. The tree is joined with itself from the
   top. A pair of nodes carries the differences found so far and adds those of the bits that its own masks newly share;
   beyond 2 the two groups are pruned whole.
5. Links found in a task are joined to trees of at most one edge a fingerprint, so no group emits its pairs. Connected
   components over those edges run as large-star and small-star rounds, each written to the shared folder.

Defined results: null, empty and blank texts have fingerprint zero, which links like any other. Rows with a null
``doc_id`` are kept; a component of only such rows has a null id. Repeated rows stay repeated. An empty table gives an
empty result. Other columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, columns, slices

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: First bit and number of bits of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Distinct fingerprints with one value above which the value is split by the remaining bits.
HOT = 50_000
FAN_OUT = 8


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        spans = map(slice, starts, ends[shingle - 1 :].tolist())
        hashes = list(map(xxh64_intdigest, map(joined.__getitem__, spans), repeat(seed)))
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed integer."""
    ones = np.zeros(64, dtype=np.int64)
    raw = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, column: str, keep: bool, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with a column ``__fp`` (long) made from the text in ``column``, which goes unless ``keep``."""
    names = [n for n in docs.columns if keep or n != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            fps = [fingerprint(t, shingle, seed) for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(fps, pa.int64())], names=[*names, "__fp"])

    return docs.mapInArrow(run, docs.select(*names).schema.add("__fp", "long"))


def rotated(fps: np.ndarray, first: int, size: int) -> np.ndarray:
    """Fingerprints rotated so that the block's bits are the highest."""
    up = np.uint64((64 - first - size) % 64)
    down = np.uint64((64 - int(up)) % 64)
    return fps if int(up) == 0 else fps << up | fps >> down


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray sequence."""
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


class GrayIndex:
    """A tree over code words sorted by Gray rank; a node has the bits that all its words share.

    ``levels[0]`` are the words; node i of a level covers nodes ``FAN_OUT * i`` and following of the level below.
    """

    def __init__(self, words: np.ndarray):
        self.words = words[np.argsort(gray_rank(words), kind="stable")]
        pattern, mask = self.words, np.full(len(words), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        self.levels = [(pattern, mask)]
        while len(pattern) > FAN_OUT:
            starts = np.arange(0, len(pattern), FAN_OUT)
            first = np.repeat(pattern[starts], np.diff(np.append(starts, len(pattern))))
            differ = np.bitwise_or.reduceat(pattern ^ first, starts)
            mask = np.bitwise_and.reduceat(mask, starts) & ~differ
            pattern = pattern[starts] & mask
            self.levels.append((pattern, mask))

    def close_pairs(self, distance: int, equal_bits: int, chunk: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of words that agree on the highest ``equal_bits`` and differ in at most ``distance`` others."""
        exact = np.uint64(((1 << equal_bits) - 1) << (64 - equal_bits)) if equal_bits else np.uint64(0)
        top = len(self.levels) - 1
        a, b = np.triu_indices(len(self.levels[top][0]))
        none = np.zeros(len(a), dtype=np.uint64)
        stack = [(top, a, b, none, none.astype(np.uint8))]
        while stack:
            level, a, b, seen, found = stack.pop()
            if len(a) > chunk:
                for at in range(0, len(a), chunk):
                    stack.append((level, *(x[at : at + chunk] for x in (a, b, seen, found))))
                continue
            pattern, mask = self.levels[level]
            shared = mask[a] & mask[b]
            differ = (pattern[a] ^ pattern[b]) & shared & ~seen
            found = found + np.bitwise_count(differ)
            near = (found <= distance) & (differ & exact == 0)
            a, b, seen, found = a[near], b[near], shared[near], found[near]
            if level == 0:
                apart = a != b
                yield a[apart], b[apart]
                continue
            below, wide = len(self.levels[level - 1][0]), FAN_OUT * FAN_OUT
            i, j = (x.ravel() for x in np.meshgrid(np.arange(FAN_OUT), np.arange(FAN_OUT), indexing="ij"))
            a = (a[:, None] * FAN_OUT + i).ravel()
            b = (b[:, None] * FAN_OUT + j).ravel()
            fits = (a <= b) & (a < below) & (b < below)
            a, b, seen, found = a[fits], b[fits], np.repeat(seen, wide)[fits], np.repeat(found, wide)[fits]
            if len(a):
                stack.append((level - 1, a, b, seen, found))

    def roots(self, distance: int, equal_bits: int) -> np.ndarray:
        """For each word the least index of the words it is linked with, directly or through others."""
        parent = np.arange(len(self.words))
        for a, b in self.close_pairs(distance, equal_bits):
            while len(a):
                a, b = parent[a], parent[b]
                apart = a != b
                a, b = a[apart], b[apart]
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
                while True:
                    up = parent[parent]
                    if (up == parent).all():
                        break
                    parent = up
        return parent


def local_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For all fingerprints of a task, by block: an edge to the first word of each local component."""
    parts: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        block, mask = batch.column("block").to_numpy(), batch.column("mask").to_numpy()
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for key in set(zip(block.tolist(), mask.tolist(), strict=True)):
            parts.setdefault(key, []).append(fps[(block == key[0]) & (mask == key[1])])
    for block, mask in sorted(parts):
        fps = np.unique(np.concatenate(parts.pop((block, mask))))
        first, size = BLOCKS[block]
        index = GrayIndex(rotated(fps, first, size))
        root = index.roots(DISTANCE, size)
        words = rotated(index.words, 0, 64 - first - size)  # rotated back: the block returns to its place
        member = root != np.arange(len(root))
        if member.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[member].view(np.int64)), pa.array(words[root[member]].view(np.int64))], names=["a", "b"]
            )


def signed(mask: int) -> int:
    return mask - (mask >> 63 << 64)


def finer_masks(mask: int) -> list[int]:
    """The bits outside ``mask`` in three parts, each with ``mask``. Two words that agree on the mask and differ in at
    most two bits agree on one of them."""
    rest = [1 << i for i in range(64) if not mask >> i & 1]
    return [mask | sum(rest[len(rest) * k // 3 : len(rest) * (k + 1) // 3]) for k in range(DISTANCE + 1)]


def candidate_blocks(distinct: DataFrame, hot: int, scratch: Scratch) -> DataFrame:
    """(block, mask, value, fp): where each fingerprint is searched, by its value of the mask's bits.

    Values of more than ``hot`` fingerprints are split by the other bits, again and again if need be.
    """
    spark = scratch.spark
    masks = [((1 << size) - 1) << at for at, size in BLOCKS]
    value = F.col("fp").bitwiseAND(F.col("mask")).alias("value")
    first = F.array(*[F.struct(F.lit(i).alias("block"), F.lit(signed(m)).alias("mask")) for i, m in enumerate(masks)])
    rows = distinct.select("fp", F.inline(first)).select("fp", "block", "mask", value)
    done: list[DataFrame] = []
    while True:
        open_ = [m for m in masks if 64 - m.bit_count() > DISTANCE]
        counted = rows.where(F.col("mask").isin([signed(m) for m in open_])).groupBy("block", "mask", "value").count()
        crowded = scratch.write(counted.where(F.col("count") > hot).select("block", "mask", "value"), "hot")
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows])
        marked = scratch.write(rows.join(crowded.withColumn("crowded", F.lit(True)).hint("merge"), ["block", "mask", "value"], "left"), "seats")
        done.append(marked.where("crowded IS NULL").drop("crowded"))
        # Which masks are crowded: three times as many at most as one level before.
        known = [r.mask for r in crowded.select("mask").distinct().collect()]
        finer = {m: finer_masks(m) for m in open_ if signed(m) in known}
        table = spark.createDataFrame([(signed(m), signed(f)) for m, fs in finer.items() for f in fs], "mask long, finer long")
        split = marked.where("crowded").select("fp", "block", "mask").join(F.broadcast(table), "mask")
        rows = split.select("fp", "block", F.col("finer").alias("mask")).select("fp", "block", "mask", value)
        masks = [f for fs in finer.values() for f in fs]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Alternating large-star and small-star rounds until the edge set stays as it is.
    """
    edges = scratch.write(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m"), "least")
        large = both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").distinct()
        grown = scratch.write(large, "large")
        least_small = scratch.write(grown.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = (
            grown.join(least_small, "a").where("b <> m").selectExpr("b AS a", "m AS b").union(least_small.selectExpr("a", "m AS b")).distinct()
        )
        new = scratch.write(small.selectExpr("greatest(a, b) AS a", "least(a, b) AS b"), "edges")
        after = state(new)
        scratch.drop(edges, least, grown, least_small)
        edges = new
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def fingerprint_edges(distinct: DataFrame, hot: int, scratch: Scratch) -> DataFrame:
    """(a, b) that link all different fingerprints (fp) within ``DISTANCE`` bits into their components."""
    rows = candidate_blocks(distinct, hot, scratch)
    return rows.repartition("block", "mask", "value").select("block", "mask", "fp").mapInArrow(local_links, "a long, b long")


def component_of(ids: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """From (doc_id, fp) rows: (fp, component_id, members' least ``rid`` if there is one) per distinct fingerprint."""
    least = [F.min("doc_id").alias("doc_id")]
    if "rid" in ids.columns:
        least = [F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")).alias("first")]
    distinct = scratch.write(ids.groupBy("fp").agg(*least), "distinct")
    stars = components(fingerprint_edges(distinct.select("fp"), hot, scratch), scratch)
    value = "first" if "rid" in ids.columns else "doc_id"
    rooted = distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", value, F.coalesce("root", "fp").alias("root"))
    rooted = scratch.write(rooted, "rooted")
    groups = scratch.write(rooted.groupBy("root").agg(F.min(value).alias("least")), "groups")
    return scratch.write(rooted.select("fp", "root").join(groups, "root").select("fp", "least"), "components")


def near_duplicates(spark: SparkSession, docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fp (long) and component_id of every row: components link at ``DISTANCE`` or fewer differing bits."""
    scratch = Scratch(spark, "simhash")
    texts = columns(docs, doc_id="doc_id", text="text").withColumn("text", F.col("text").cast("string"))
    ids = scratch.write(fingerprints(texts, "text", keep=False).withColumnRenamed("__fp", "fp"), "ids")
    found = component_of(ids, scratch, hot).withColumnRenamed("least", "component_id")
    return ids.join(found, "fp").select("doc_id", "fp", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row of each component of near-duplicates, with all columns: that of the smallest doc_id.

    Ties between repeated ids go to the row read first. A row number per task, written with the fingerprints, tells
    repeated rows apart; texts are written once and move once.
    """
    scratch = Scratch(spark, "simhash")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: f"c{i}" for i, n in enumerate(names)}
    # Ids are made once: the written table is what every later step reads.
    numbered = plain.withColumn(at["text"], F.col(at["text"]).cast("string")).withColumn("rid", F.monotonically_increasing_id())
    table = scratch.write(fingerprints(numbered, at["text"], keep=True).withColumnRenamed("__fp", "fp"), "rows")
    ids = table.select(F.col(at["doc_id"]).alias("doc_id"), "fp", "rid")
    found = component_of(ids, scratch, hot).select(F.col("least.rid").alias("rid")).distinct()
    # Rows kept grow with the input, so they are never broadcast: the plan is the same at every size.
    kept = table.join(scratch.write(found, "kept").hint("merge"), "rid", "left_semi")
    return kept.select(*[F.col(at[n]).alias(n) for n in names])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
