"""Near-duplicates at a resemblance (Jaccard) of 0.8 or more of five-word shingles: SimHash candidates and min-wise bands,
checked exactly.

SimHash alone does not reach 0.8: such texts are up to 17 of 64 bits apart, too wide for an index that misses no pair.
So what its Gray-order index links is joined by bands of min-wise hashes, and every link is checked on the shingles.

1. One pass over whole texts makes each text's set of shingle hashes and from it an id of the set (copies are one set),
   its size, its SimHash and ``BANDS`` hashes of ``ROWS`` minima each. Texts are written once. Two sets of resemblance
   0.8 share a band with a probability over 0.9999.
2. Each band value has a pivot, one of its sets. Every other set makes a candidate with the pivot, whatever the number
   of sets; so do neighbours in the SimHash index. Candidates are compared exactly and give the first components.
3. What is left are sets of one band value in different components. At most ``crowd`` of them make pairs, without those
   that the distances from the pivot rule out. Of more, the sets outside the largest component meet all others in
   blocks of ``part`` by ``part`` sets, and a block gives at most one link a component.
4. Connected components over all links are those of ``simhash``.

Defined results: texts without words are alike, a text of fewer words than a shingle is one shingle. Rows with a null
``doc_id`` are kept as the least of their group only if it has no other. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import Scratch, slices
from factloom.llm.simhash import HOT, components, fingerprint_edges, majority

SHINGLE = 5
SEED = 42
BANDS, ROWS = 20, 4
#: Sets of one band value and several components above which they make no pairs.
CROWD = 16
#: Sets on a side of a block.
PART = 256

_rng = np.random.default_rng(20)
_ADD, _TIMES = (_rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_TIMES = _TIMES * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def all_shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The shingle hashes of a text in order, repeats included (uint64)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= size:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - size] + 1).tolist()]
        hashes = list(map(xxh64_intdigest, map(joined.__getitem__, map(slice, starts, ends[size - 1 :].tolist())), repeat(SEED)))
    return np.array(hashes, dtype=np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The different shingle hashes of a text, ascending (uint64)."""
    return np.unique(all_shingles(text, size))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash for each band: of the minima of the set under the band's permutations (int64); none for the empty set."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[at : at + 2048, None] + _ADD) * _TIMES).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for k in range(ROWS):
        out = (out ^ rows[:, k]) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def alike(common: Column | int, total: Column | int):  # noqa: ANN201
    """Whether two sets of ``total`` shingles together, counted apart, have a resemblance of 0.8 or more."""
    return 9 * common >= 4 * total


def fits(a: Column, b: Column) -> Column:
    """Whether the sizes of two sets allow 0.8."""
    return (5 * a >= 4 * b) & (5 * b >= 4 * a)


def with_marks(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the id ``sid`` of the text's set of shingles, its size ``n``, its SimHash ``fp`` and its ``bands``."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in slices(batches, text, 2 << 20):
            ids, sizes, fps, marks = [], [], [], []
            for t in batch.column(text).to_pylist():
                every = all_shingles(t)
                own = np.unique(every)
                ids.append(xxh3_64_intdigest(own.tobytes()))
                sizes.append(len(own))
                fps.append(majority(every) if len(every) else 0)
                marks.append(bands(own))
            made = [pa.array(np.array(ids, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "sid", "n", "fp", "bands"])

    return docs.mapInArrow(run, docs.select(*names).schema.add("sid", "long").add("n", "integer").add("fp", "long").add("bands", T.ArrayType(T.LongType())))


def sets(texts: DataFrame) -> DataFrame:
    """(sid, hs) of (sid, text): the shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            made = [shingles(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(made, pa.list_(pa.int64()))], names=["sid", "hs"])

    return texts.select("sid", "text").mapInArrow(run, "sid long, hs array<long>")


def pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def compared(pairs: DataFrame, shingle_sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the number of common shingles and the sum of both sizes."""
    one = pairs.join(shingle_sets.select(F.col("sid").alias("a"), F.col("hs").alias("ha")), "a")
    both = one.join(shingle_sets.select(F.col("sid").alias("b"), F.col("hs").alias("hb")), "b")
    return both.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("common"), (F.size("ha") + F.size("hb")).alias("total"))


def block_links(table: pa.Table) -> pa.Table:
    """Links among the sets of a block (sid, root, side, hs): between the sides, and at most one a component."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("side", "sid", "root", "hs")), strict=True))
    probes, targets = ([(s, r, h) for side, s, r, h in rows if side == k] for k in (0, 1))
    having: dict[int, list[int]] = {}
    for k, (_, _, hs) in enumerate(targets):
        for h in hs:
            having.setdefault(h, []).append(k)
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    links = []
    for sid, root, hs in sorted(probes):
        at = [k for h in hs for k in having.get(h, ())]
        common = np.bincount(np.array(at, dtype=np.int64), minlength=len(targets))
        for k in np.flatnonzero(common).tolist():
            other, other_root, other_hs = targets[k]
            if top(root) != top(other_root) and alike(int(common[k]), len(hs) + len(other_hs)):
                up[max(top(root), top(other_root))] = min(top(root), top(other_root))
                links.append((sid, other))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def crowded_links(members: DataFrame, shingle_sets: DataFrame, scratch: Scratch, part: int) -> DataFrame:
    """Links of crowded band values from (h, sid, root): sets outside a value's largest component against all of it."""
    weight = members.groupBy("h", "root").agg(F.count("*").alias("n"))
    most = weight.groupBy("h").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("most"))
    most = scratch.write(most.select("h", "all", (F.col("all") - F.col("most.n")).alias("few"), F.col("most.root").alias("main")), "most")
    met = members.join(most, "h")
    parts = lambda n: F.ceil(F.col(n) / part).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("sid", "h"), n).cast("int")
    probes = met.where("root <> main").select("h", "sid", "root", F.lit(0).alias("side"), own(parts("few")).alias("i"), every(parts("all")).alias("j"))
    targets = met.select("h", "sid", "root", F.lit(1).alias("side"), own(parts("all")).alias("j"), every(parts("few")).alias("i"))
    seats = probes.unionByName(targets).join(shingle_sets, "sid").select("h", "i", "j", "side", "sid", "root", "hs")
    return seats.groupBy("h", "i", "j").applyInArrow(block_links, "a long, b long")


def links(each: DataFrame, texts: DataFrame, scratch: Scratch, crowd: int = CROWD, part: int = PART, hot: int = HOT) -> DataFrame:
    """(node, root) of all sets that are linked with another one.

    ``each`` has a row a set: sid, n, fp, bands, rid; ``texts`` (rid, text) has at least the rows of these rids.
    """

    def release(*tables: DataFrame) -> None:
        """Delete tables and let the driver drop the shuffle files of steps that are over."""
        scratch.drop(*tables)
        gc.collect()
        scratch.spark._jvm.System.gc()

    marks = each.select(F.explode("bands").alias("h"), "sid", "n")
    # One of the sets of a band value, another one in each band: the least by a hash of both.
    order = F.struct(F.xxhash64("sid", "h").alias("r"), "sid", "n")
    pivots = marks.groupBy("h").agg(F.min(order).alias("p"), F.min("sid").alias("low"), F.max("sid").alias("high")).where("low <> high")
    pivots = scratch.write(pivots.select("h", F.col("p.sid").alias("pivot"), F.col("p.n").alias("pn")), "pivots")
    met = scratch.write(marks.join(pivots.hint("merge"), "h").select("h", "sid", "n", "pivot", "pn"), "met")
    near = fingerprint_edges(each.select("fp").distinct(), hot, scratch)
    first_of = each.groupBy("fp").agg(F.min(F.struct("sid", "n")).alias("s"))
    same = each.join(first_of.hint("merge"), "fp").select("sid", "n", F.col("s.sid").alias("pivot"), F.col("s.n").alias("pn"))
    ends = [first_of.select(F.col("fp").alias(c), F.col("s.sid").alias(f"s{c}"), F.col("s.n").alias(f"n{c}")).hint("merge") for c in "ab"]
    across = near.join(ends[0], "a").join(ends[1], "b").select(F.col("sa").alias("sid"), F.col("na").alias("n"), F.col("sb").alias("pivot"), F.col("nb").alias("pn"))
    found = met.drop("h").unionByName(same).unionByName(across).where((F.col("sid") != F.col("pivot")) & (F.col("n") > 0) & fits(F.col("n"), F.col("pn")))
    stars = scratch.write(found.select(*pair("sid", "pivot")).distinct(), "stars")
    ids = met.select("sid").union(stars.select("a")).union(stars.select("b")).distinct().join(each.select("sid", "rid").hint("merge"), "sid")
    ids = scratch.write(ids.select("sid", "rid"), "ids")
    release()
    shingle_sets = scratch.write(sets(texts.join(ids.hint("merge"), "rid").select("sid", "text")), "sets")
    release(ids)
    measured = scratch.write(compared(stars, shingle_sets), "measured")
    close = measured.where(alike(F.col("common"), F.col("total"))).select("a", "b")
    release(stars)
    roots = components(close, scratch)
    release()

    # What is left: sets of one band value in different components.
    rooted = met.join(roots.hint("merge"), met["sid"] == roots["node"], "left").select("h", "sid", "n", "pivot", F.coalesce("root", "sid").alias("root"))
    rooted = scratch.write(rooted, "rooted")
    several = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low <> high")
    several = scratch.write(several.select("h", "m"), "several")
    # The distance from the pivot, where it was measured: two sets can't be nearer than their distances differ.
    apart = measured.select("a", "b", (1 - F.col("common") / (F.col("total") - F.col("common"))).alias("d"))
    few = rooted.join(several.where(F.col("m") <= crowd).select("h").hint("merge"), "h")
    few = few.select("*", *pair("sid", "pivot")).join(apart.hint("merge"), ["a", "b"], "left").select("h", "sid", "n", "root", "d")
    lists = few.groupBy("h").agg(F.collect_list(F.struct("sid", "n", "root", "d")).alias("m"))
    open_ = lambda x, y: (
        (x["sid"] < y["sid"]) & (x["root"] != y["root"]) & fits(x["n"], y["n"]) & F.coalesce(F.abs(x["d"] - y["d"]) <= 0.2 + 1e-9, F.lit(True))
    )
    pairs = lists.select(F.explode("m").alias("x"), "m").select("x", F.explode(F.filter("m", lambda y: open_(F.col("x"), y))).alias("y"))
    pairs = pairs.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct().join(measured.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
    pairs = scratch.write(pairs, "pairs")
    more = compared(pairs, shingle_sets).where(alike(F.col("common"), F.col("total"))).select("a", "b")
    crowded = rooted.join(several.where(F.col("m") > crowd).select("h").hint("merge"), "h").select("h", "sid", "root")
    more = scratch.write(more.unionByName(crowded_links(crowded, shingle_sets, scratch, part)), "more")
    release(met, rooted, shingle_sets, pairs)
    out = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), scratch)
    release(measured, more)
    return out


def keep_one(spark: SparkSession, docs: DataFrame, crowd: int = CROWD, part: int = PART) -> DataFrame:
    """One row of each group of near-duplicates, with all columns: that of the smallest doc_id, of ties the first read."""
    scratch = Scratch(spark, "resemblance")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: f"c{i}" for i, n in enumerate(names)}
    numbered = plain.withColumn(at["text"], F.col(at["text"]).cast("string")).withColumn("rid", F.monotonically_increasing_id())
    table = scratch.write(with_marks(numbered, at["text"]), "rows")
    first = F.min(F.struct(F.col(at["doc_id"]).isNull().alias("n"), F.col(at["doc_id"]).alias("doc_id"), "rid")).alias("first")
    marks = [F.any_value(c).alias(c) for c in ("n", "fp", "bands")]
    each = scratch.write(table.groupBy("sid").agg(first, *marks), "each")
    rows = each.select("sid", "n", "fp", "bands", F.col("first.rid").alias("rid"))
    stars = links(rows, table.select("rid", F.col(at["text"]).alias("text")), scratch, crowd, part)
    rooted = each.join(stars.hint("merge"), each["sid"] == stars["node"], "left").select("first", F.coalesce("root", "sid").alias("root"))
    kept = scratch.write(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid")), "kept")
    scratch.drop(each)
    # Rows kept grow with the input, so they are never broadcast: the plan is the same at every size.
    return table.join(kept.hint("merge"), "rid", "left_semi").select(*[F.col(at[n]).alias(n) for n in names])
