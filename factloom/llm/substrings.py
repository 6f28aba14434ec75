"""Repeated-substring removal over a whole corpus through suffix arrays of the places that can repeat.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Matches never cross documents.

1. Anchors. Of the ``GRAM``-byte substrings inside a window of ``LENGTH`` bytes, the one with the least hash is the
   window's anchor (the leftmost of equals), so equal windows have equal anchors at the same place. One pass writes each
   document's anchors with a hash of their context: the anchor and all that a window around it can reach.
2. Only anchors that occur more than once go on. Equal contexts are counted: a context that occurs twice is repeated
   from end to end, however many copies there are.
3. For anchors with several different contexts, one of each is read back from its document. Those of one anchor are put
   together, with the common anchor as one symbol, and sorted by linear suffix grouping (``suffix_grouping``); windows
   that are neighbours in that order are compared exactly.
4. Anchors with more than ``CROWD`` different contexts are split by where a window stands around the anchor and by the
   bytes that all such windows share, twice if need be; after that a window is one symbol and equal rows are counted.
5. The covered stretches of each text are gathered by the text's key and cut out in a last pass.

Documents stand for their text's key in steps 3 and 5, so copies add no groups. Every table is written to the shared
folder and is dropped when the next no longer needs it.

Defined results: null is the empty text; texts under ``LENGTH`` bytes lose nothing. A null ``doc_id`` stays null.
Repeated rows are copies of each other and lose what they share. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import Scratch, columns, slices, text_key
from factloom.llm.suffix_grouping import ranges, suffix_arrays

LENGTH = 400
GRAM = 256
#: Different contexts of one anchor that are sorted together.
CROWD = 32
#: Parts a crowded anchor's windows are split into.
PARTS = 12
#: Symbols that a task sorts at a time.
SYMBOLS = 1_500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2 ** 64 and their inverses."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, dtype=np.uint64)), dtype=np.uint64) for b in (_BASE, inverse))
    return _powers[0][:n], _powers[1][:n]


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Positions of the anchors of all windows of the documents that end at ``ends`` in ``data``, ascending."""
    n, wide = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, dtype=np.int64)
    power, inverse = _power_tables(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    code = (sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1]
    code ^= code >> np.uint64(32)
    code *= np.uint64(0xD6E8FEB86659FD93)
    # High half: the hash that is minimised. Low half: the place, so that the leftmost of equals is least.
    code &= np.uint64(0xFFFFFFFF00000000)
    code |= np.arange(len(code), dtype=np.uint64)
    rows = np.full(-(-len(code) // wide) * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
    rows[: len(code)] = code
    rows = rows.reshape(-1, wide)
    up_to = np.minimum.accumulate(rows, axis=1).ravel()
    onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(onward[: n - length + 1], up_to[wide - 1 : wide - 1 + n - length + 1])
    starts = np.append(0, ends[:-1])
    fits = ends - starts >= length
    inside = np.zeros(n + 1, dtype=np.int8)
    inside[starts[fits]] += 1
    inside[ends[fits] - length + 1] -= 1
    whole = np.cumsum(inside[: n - length + 1]) > 0
    return np.unique(least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)


ANCHORS = "a long, c long, key binary, pos int, lead int, tail int"


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """From (key, text): anchor hash a, context hash c, and the context's bytes before (lead) and after (tail)."""
    side = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in slices(batches, "text", 1 << 18):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            joined, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
            at = anchors(np.frombuffer(joined, dtype=np.uint8), ends, length, gram)
            if not len(at):
                continue
            doc = np.searchsorted(ends, at, side="right")
            start = np.append(0, ends)[doc]
            lead, tail = np.minimum(side, at - start), np.minimum(side, ends[doc] - at - gram)

            def hashed(first: np.ndarray, last: np.ndarray, seeds: Iterable[int]) -> pa.Array:
                parts = map(joined.__getitem__, map(slice, first.tolist(), last.tolist()))
                return pa.array(np.fromiter(map(xxh3_64_intdigest, parts, seeds), np.uint64, len(first)).view(np.int64))

            yield pa.RecordBatch.from_arrays(
                [
                    hashed(at, at + gram, repeat(0)),
                    hashed(at - lead, at + gram + tail, (lead + 1).tolist()),
                    batch.column("key").take(pa.array(doc)),
                    *(pa.array(v.astype(np.int32)) for v in (at - start, lead, tail)),
                ],
                names=["a", "c", "key", "pos", "lead", "tail"],
            )

    return docs.mapInArrow(run, ANCHORS)


ROWS = "g long, g2 long, low int, high int, before binary, after binary, a long, c long"


def context_rows(docs: DataFrame, wanted: DataFrame, gram: int, side: int) -> DataFrame:
    """The contexts of (key, refs of (a, c, pos, lead, tail)), grouped by two hashes of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in slices(batches, "text", 1 << 20):
            out: list[list] = [[] for _ in range(8)]
            for text, refs in zip(batch.column("text").to_pylist(), batch.column("refs").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for r in refs:
                    p = r["pos"]
                    g2 = xxh3_64_intdigest(data[p : p + gram], 977)
                    row = (r["a"], g2 - (g2 >> 63 << 64), 0, side, data[p - r["lead"] : p], data[p + gram : p + gram + r["tail"]], r["a"], r["c"])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield _rows(out)

    met = docs.join(wanted, "key").select("text", "refs")
    return met.mapInArrow(run, ROWS).dropDuplicates(["a", "c"])


def _rows(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)], names=names)


def finer_rows(rows: DataFrame, parts: int) -> DataFrame:
    """Each context as several, one for each part of its windows, grouped by the bytes that all windows of the part share.

    A window with r bytes after the anchor has high - r bytes before it (beyond what is already shared). Windows with r
    in [x, y] share the high - y bytes before the anchor and the x bytes after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for r in batch.to_pylist():
                low, high, before, after = r["low"], r["high"], r["before"], r["after"]
                cuts = np.unique(np.linspace(low, high + 1, min(parts, high - low + 1) + 1).astype(int)).tolist()
                for x, y in zip(cuts, [c - 1 for c in cuts[1:]], strict=False):
                    near, ahead = high - y, x - low
                    if len(before) < near or len(after) < ahead:
                        continue
                    shared = before[len(before) - near :] + after[:ahead]
                    g = xxh3_128_intdigest(b"%d %d %d %d " % (r["g"], r["g2"], x, y) + shared)
                    rest = before[max(0, len(before) - (high - x)) : len(before) - near]
                    made = (g >> 64, g & (1 << 64) - 1)
                    row = (*(v - (v >> 63 << 64) for v in made), x, y, rest, after[ahead : y - low], r["a"], r["c"])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield _rows(out)

    return rows.mapInArrow(run, ROWS)


def equal_windows(text: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` symbols from ``one`` and from ``two`` are the same, symbol by symbol.

    Windows at one distance that overlap are compared together, so a symbol is compared once for all of them.
    """
    equal = np.zeros(len(one), dtype=bool)
    if not len(one):
        return equal
    apart = two - one
    by = np.lexsort((one, apart))
    one, apart, size = one[by], apart[by], size[by]
    opens = np.append(True, (apart[1:] != apart[:-1]) | (one[1:] > one[:-1] + size[:-1]))
    first = np.flatnonzero(opens)
    run = np.cumsum(opens) - 1
    start, wide = one[first], np.maximum.reduceat(one + size, first) - one[first]
    places = ranges(start, wide)
    differ = np.append(0, np.cumsum(text[places] != text[places + np.repeat(apart[first], wide)]))
    at = (np.cumsum(wide) - wide)[run] + one - start[run]
    equal[by] = differ[at + size] == differ[at]
    return equal


def repeated_windows(groups: list[list[tuple[int, int, bytes, bytes]]]) -> list[list[list[tuple[int, int]]]]:
    """For each group of (low, high, before, after) the runs [first, last] of r whose window another row has too."""
    texts, bounds, starts, owners = [], [0], [], []
    for group in groups:
        parts = []
        for low, high, before, after in group:
            # 0 parts the contexts, 1 is the anchor, bytes follow.
            parts += [np.zeros(1, np.int16), np.frombuffer(before, np.uint8).astype(np.int16) + 2, np.ones(1, np.int16), np.frombuffer(after, np.uint8).astype(np.int16) + 2]
        text = np.concatenate(parts)
        texts.append(text)
        bounds.append(bounds[-1] + len(text))
    text, at = np.concatenate(texts), np.array(bounds)
    order = suffix_arrays(text, at)
    # Which positions start a whole window, and of which row and r.
    row_of, r_of = np.full(len(text), -1, dtype=np.int64), np.zeros(len(text), dtype=np.int64)
    size_of = np.zeros(len(text), dtype=np.int64)
    n = 0
    for i, group in enumerate(groups):
        place = bounds[i]
        for low, high, before, after in group:
            first, last = max(low, high - len(before)), min(high, low + len(after))
            if first <= last:
                r = np.arange(first, last + 1)
                where = place + 1 + len(before) - (high - r)
                row_of[where], r_of[where], size_of[where] = n, r, high - low + 1
            place += len(before) + len(after) + 2
            n += 1
    group_of = np.repeat(np.arange(len(groups)), np.diff(at))
    windows = order[row_of[order] >= 0].astype(np.int64)
    one, two = windows[:-1], windows[1:]
    same = (group_of[one] == group_of[two]) & (size_of[one] == size_of[two])
    one, two = one[same], two[same]
    equal = equal_windows(text, one, two, size_of[one])
    marked = np.zeros(len(text), dtype=bool)
    marked[one[equal]] = marked[two[equal]] = True
    hit = np.flatnonzero(marked)
    rows, r = row_of[hit], r_of[hit]
    by = np.lexsort((r, rows))
    rows, r = rows[by], r[by]
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if len(rows):
        opens = np.append(True, (rows[1:] != rows[:-1]) | (r[1:] != r[:-1] + 1))
        first = np.nonzero(opens)[0]
        final = np.append(first[1:], len(rows)) - 1
        for i, x, y in zip(rows[first].tolist(), r[first].tolist(), r[final].tolist(), strict=True):
            out[i].append((x, y))
    found, n = [], 0
    for group in groups:
        found.append(out[n : n + len(group)])
        n += len(group)
    return found


def _shared(group: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For each text the longest prefix that it shares with another text of its group."""
    n, wide = len(texts), max(map(len, texts), default=0)
    size = np.fromiter(map(len, texts), np.int64, n)
    best = np.zeros(n, dtype=np.int64)
    if not wide:
        return best
    padded = np.frombuffer(b"".join(t.ljust(wide, b"\0") for t in texts), dtype=f"S{wide}")
    order = np.lexsort((padded, group))  # in order, a text's longest common prefix is with a neighbour
    table = padded.view(np.uint8).reshape(n, wide)
    for at in range(0, n - 1, 20_000):
        one, two = order[at : min(at + 20_000, n - 1)], order[at + 1 : at + 20_001]
        differ = table[one] != table[two]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        common = np.minimum(common, np.minimum(size[one], size[two])) * (group[one] == group[two])
        np.maximum.at(best, one, common)
        np.maximum.at(best, two, common)
    return best


def shortened(groups: list[list[tuple[int, int, bytes, bytes]]]) -> list[list[tuple[int, int, bytes, bytes]]]:
    """Groups whose rows end where they share nothing with another row of the group; rows too short for a window are empty.

    A window that another row has too lies in what the row shares with it before and after the anchor.
    """
    rows = [row for group in groups for row in group]
    of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    lead, tail = _shared(of, [r[2][::-1] for r in rows]).tolist(), _shared(of, [r[3] for r in rows]).tolist()
    cut = [
        (low, high, before[len(before) - b :], after[:a]) if a + b >= high - low else (low, high, b"", b"")
        for (low, high, before, after), b, a in zip(rows, lead, tail, strict=True)
    ]
    ends = np.cumsum([len(g) for g in groups]).tolist()
    return [cut[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]


def sorted_groups(rows: DataFrame) -> DataFrame:
    """g, g2, k (the row's class) and the runs of repeated windows, by suffix grouping of each (g, g2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[tuple, list[int], list[tuple[int, int, bytes, bytes]]]] = []
        symbols = 0

        def flush() -> pa.RecordBatch:
            nonlocal symbols
            cut = [(key, ks, group) for (key, ks, _), group in zip(waiting, shortened([w[2] for w in waiting]), strict=True)]
            # Rows without a window that could be repeated have no part; at low = high a window is the anchor alone.
            cut = [(key, [k for k, r in zip(ks, g, strict=True) if r[2] or r[3] or r[0] == r[1]], [r for r in g if r[2] or r[3] or r[0] == r[1]]) for key, ks, g in cut]
            cut = [w for w in cut if len(w[2]) > 1]
            # Strings of like length together: each step then has work in all of them.
            cut.sort(key=lambda w: sum(len(b) + len(c) for _, _, b, c in w[2]))
            out: list[list] = [[], [], [], [], []]
            for (key, ks, _), runs in zip(cut, repeated_windows([w[2] for w in cut]) if cut else [], strict=True):
                for k, each in zip(ks, runs, strict=True):
                    for x, y in each:
                        for column, value in zip(out, (*key, k, x, y), strict=True):
                            column.append(value)
            waiting.clear()
            symbols = 0
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=["g", "g2", "k", "x", "y"])

        for batch in batches:
            g, g2, k = (batch.column(c).to_pylist() for c in ("g", "g2", "k"))
            body = zip(*(batch.column(c).to_pylist() for c in ("low", "high", "before", "after")), strict=True)
            for key, own, row in zip(zip(g, g2, strict=True), k, body, strict=True):
                if not waiting or waiting[-1][0] != key:
                    if symbols >= SYMBOLS:
                        yield flush()
                    waiting.append((key, [], []))
                waiting[-1][1].append(own)
                waiting[-1][2].append(row)
                symbols += len(row[2]) + len(row[3]) + 2
        if waiting:
            yield flush()

    # Dealt by a hash of the keys: a deal by the keys themselves is left out of the plan after a join on them, and then the
    # adaptive execution may split a group among tasks, since mapInArrow asks for no distribution.
    return rows.repartition(F.xxhash64("g", "g2")).sortWithinPartitions("g", "g2").mapInArrow(run, "g long, g2 long, k long, x int, y int")


def repeated_contexts(rows: DataFrame, scratch: Scratch, crowd: int, parts: int) -> DataFrame:
    """(a, c, x, y): windows with x to y bytes after anchor a are repeated in context c."""
    found, level = None, 0
    while True:
        classes = rows.groupBy("g", "g2", F.xxhash64("before", "after", F.length("before")).alias("k")).agg(
            F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("low", "high", "before", "after")]
        )
        classes = scratch.write(classes, "classes")
        sizes = scratch.write(classes.groupBy("g", "g2").agg(F.count("*").alias("m"), F.max("high").alias("h"), F.min("low").alias("l")), "sizes")
        few = classes.join(sizes.where(F.col("m").between(2, crowd)).select("g", "g2"), ["g", "g2"])
        runs = sorted_groups(few.select("g", "g2", "k", "low", "high", "before", "after"))
        runs = runs.union(classes.where("n > 1").select("g", "g2", "k", F.col("low").alias("x"), F.col("high").alias("y")))
        runs = scratch.write(runs, "runs")
        keyed = rows.select("g", "g2", F.xxhash64("before", "after", F.length("before")).alias("k"), "a", "c", "low", "high", F.length("before").alias("b"), F.length("after").alias("f"))
        met = keyed.join(runs, ["g", "g2", "k"])
        # A whole class reaches as far as its bytes do.
        x, y = F.greatest("x", F.col("high") - F.col("b")), F.least("y", F.col("low") + F.col("f"))
        made = met.select("a", "c", x.alias("x"), y.alias("y")).where("x <= y")
        found = made if found is None else found.union(made)
        crowded = scratch.write(sizes.where((F.col("m") > crowd) & (F.col("h") > F.col("l"))).select("g", "g2"), "crowded")
        if crowded.isEmpty():
            return found
        level += 1
        rows = scratch.write(finer_rows(rows.join(crowded, ["g", "g2"]), parts if level == 1 else 1 << 20), "finer")


def joined_runs(runs: Column) -> Column:
    """Sorted runs (x, y) with touching and overlapping ones as one."""

    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.array(F.struct(last["x"].alias("x"), F.greatest(last["y"], run["y"]).alias("y")))
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["y"] + 1 >= run["x"])
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(runs, F.array().cast("array<struct<x:int,y:int>>"), add)


def covered(spark: SparkSession, docs: DataFrame, scratch: Scratch, length: int, gram: int, crowd: int, parts: int) -> DataFrame:
    """key and spans (start, stop) of bytes to remove, from (key, text) rows."""
    side = length - gram

    def release(*tables: DataFrame) -> None:
        """Delete tables and let the driver drop the shuffle files of steps that are over."""
        scratch.drop(*tables)
        gc.collect()
        spark._jvm.System.gc()

    found = scratch.write(anchor_rows(docs.where(F.octet_length("text") >= length), length, gram), "anchors")
    shared = found.groupBy("a").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("several"))
    shared = scratch.write(shared.where("n > 1").select("a", "several"), "shared")
    candidates = scratch.write(found.join(shared, "a"), "candidates")
    release(found, shared)
    per = candidates.groupBy("a", "c").agg(
        F.count("*").alias("n"), F.first("several").alias("several"), F.min(F.struct("key", "pos", "lead", "tail")).alias("at")
    )
    per = scratch.write(per, "contexts")
    # Where every context of an anchor is repeated as a whole there is nothing left to find.
    unsure = scratch.write(per.where("several AND n = 1").select("a").distinct(), "unsure")
    refs = per.join(unsure, "a", "left_semi").select("at.key", F.struct("a", "c", "at.pos", "at.lead", "at.tail").alias("ref"))
    wanted = scratch.write(refs.groupBy("key").agg(F.collect_list("ref").alias("refs")), "wanted")
    rows = scratch.write(context_rows(docs, wanted, gram, side), "rows")
    release(wanted)
    runs = repeated_contexts(rows, scratch, crowd, parts)
    whole = per.where("n > 1").select("a", "c", F.lit(0).alias("x"), F.lit(side).alias("y"))
    # One row a context, so that a context with many runs does not multiply its occurrences.
    runs = runs.union(whole).groupBy("a", "c").agg(joined_runs(F.sort_array(F.collect_set(F.struct("x", "y")))).alias("runs"))
    runs = scratch.write(runs, "repeated")
    release(per)
    met = candidates.join(runs, ["a", "c"]).select("key", "pos", "lead", "tail", F.inline("runs"))
    x, y = F.greatest("x", side - F.col("lead")), F.least("y", "tail")
    spans = met.where(x <= y).select("key", (F.col("pos") - side + x).alias("start"), (F.col("pos") + gram + y).alias("stop")).distinct()
    made = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    made = scratch.write(made, "spans")
    release(candidates, runs, rows)
    return made


def remove_repeats(
    spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, parts: int = PARTS
) -> DataFrame:
    """doc_id, n_bytes, kept (binary) and removed (array of start, stop) of every row."""
    scratch = Scratch(spark, "substrings")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = columns(docs, doc_id="doc_id", text="text").select("doc_id", text_key(F.col("text").cast("string")).alias("key"), text.alias("text"))
    spans = covered(spark, rows.select("key", "text"), scratch, length, gram, crowd, parts)
    met = rows.join(spans, "key", "left").select("doc_id", "text", "spans")
    schema = rows.select("doc_id").schema.add("n_bytes", "long").add("kept", "binary")
    schema = schema.add("removed", T._parse_datatype_string("array<struct<start:int,stop:int>>"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sizes, kept, removed = [], [], []
            for t, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                gone = merged(own or [])
                parts_, at = [], 0
                for s in gone:
                    parts_.append(data[at : s["start"]])
                    at = s["stop"]
                sizes.append(len(data))
                kept.append(b"".join([*parts_, data[at:]]))
                removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, kind)],
                names=["doc_id", "n_bytes", "kept", "removed"],
            )

    return met.mapInArrow(run, schema)


def merged(spans: list[dict]) -> list[dict]:
    """Spans in order, touching and overlapping ones as one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], s["stop"])
        else:
            out.append(dict(s))
    return out


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # The kept bytes as text; a character that was cut in two is U+FFFD here.
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )
