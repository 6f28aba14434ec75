"""Best-fit packing by minimum bin slack.

Lengths are at most the capacity, so the multiset of all piece lengths is a histogram of at most ``capacity`` rows
whatever the corpus; only that histogram reaches the driver. Per bin the longest remaining piece is fixed and a
bitset subset-sum dynamic programme over the available lengths finds the fullest combination for the rest. The
combination is removed as often as the histogram allows, so the number of programmes follows the number of
distinct lengths, not of documents.

Placing is distributed: a piece's rank among the pieces of its length is its rank in its task plus the counts of
earlier tasks, and the plan says for each length which ranks go to which bin and offset.

Defined results: null text is the empty text, which has only the separator token. A null ``doc_id`` stays null.
Repeated rows are separate documents. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import gc
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.llm.common import Scratch, columns, slices

CAPACITY = 2048
SEPARATOR = 0

_encoders: dict[str, Callable[[str], np.ndarray]] = {}
#: Characters whose classes are the same in every Unicode version; other texts go to the tokenizer itself.
_PLAIN = re.compile(r"[^\x00-ɏ]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 is itself, other bytes follow U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def fast_encoder(path: str) -> tuple[Callable[[str], list[int]], re.Pattern] | None:
    """A faster byte-pair implementation over the tokenizer file's vocabulary, and the file's special strings.

    None unless the merge order is the id order and the file cuts text at byte level without changing it.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    specials = [t["content"] for t in spec.get("added_tokens") or []]
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab, merges = model["vocab"], model.get("merges", [])
    ordered = all(vocab.get("".join(m if isinstance(m, list) else m.split(" "))) == 256 + i for i, m in enumerate(merges))
    plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
    if not (ordered and plain and pre.get("use_regex", True)):
        return None
    import tiktoken

    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in specials}
    fast = tiktoken.Encoding(
        "file",
        pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
        mergeable_ranks=ranks,
        special_tokens={},
    )
    fast._mergeable_ranks = {}  # the compiled part has its own copy
    return fast.encode_ordinary, re.compile("|".join(map(re.escape, specials)) or r"(?!)")


def load_encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids under the tokenizer file at ``path``, without special tokens added.

    Texts of plain characters without the file's special strings go to ``fast_encoder``, if the file has one; every
    other text is encoded by the tokenizer itself, so ids are the tokenizer's in all cases. The tokenizer is loaded when
    the first text needs it.
    """
    if path in _encoders:
        return _encoders[path]
    slow: list = []
    fast = fast_encoder(path)
    gc.collect()  # the parsed file goes before texts come

    def encode(text: str) -> np.ndarray:
        if fast and not _PLAIN.search(text) and not fast[1].search(text):
            return np.array(fast[0](text), dtype=np.uint32)
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(path))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    _encoders[path] = encode
    return encode


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("task", T.IntegerType()),
        T.StructField("rank", T.LongType()),
    ]
)
_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece of ``n`` ids: full pieces, the first may be shorter."""
    first = n % capacity or capacity
    start = 0
    while start < n:
        size = first if start == 0 else capacity
        yield start, size
        start += size


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False
) -> DataFrame:
    """One row per piece of each document, with its rank among the task's pieces of the same length."""
    schema = T.StructType([*PIECES.fields, _IDS]) if with_ids else PIECES
    names = [f.name for f in schema.fields]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in slices(batches, "text", 1 << 20):
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(separator)).astype("<u4")
                for k, (start, size) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + size]
                    row = [doc, k, start, size, zlib.crc32(part.tobytes()), task, int(seen[size])]
                    seen[size] += 1
                    for column, value in zip(out, [*row, part.astype(np.int32)] if with_ids else row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(out, kinds, strict=False)], names=names
            )

    return columns(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def fullest(rest: int, available: dict[int, int], order: list[int]) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``rest``, longer lengths first.

    Bit s of the bitset says that s can be reached; a length that is available m times is added in powers of two.
    """
    steps: list[tuple[int, int, int]] = []
    reached, want = 1, 1 << rest
    keep = (want << 1) - 1
    for size in order:
        if size > rest:
            continue
        left, k = min(available[size], rest // size), 1
        while left > 0:
            k = min(k, left)
            grown = (reached | reached << k * size) & keep
            if grown != reached:
                steps.append((size, k, reached))
                reached = grown
            left -= k
            k *= 2
        if reached & want:
            break
    total = reached.bit_length() - 1
    chosen: dict[int, int] = {}
    for size, k, before in reversed(steps):
        if not before >> total & 1:
            chosen[size] = chosen.get(size, 0) + k
            total -= k * size
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack over a histogram of lengths: (combination, number of bins filled with it)."""
    left = {size: n for size, n in histogram.items() if n > 0}
    order = sorted(left, reverse=True)
    plan = []
    while order:
        longest = order[0]
        left[longest] -= 1
        combination = fullest(capacity - longest, left, order)
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        copies = min(left[size] // k for size, k in combination.items())
        plan.append((combination, copies))
        for size, k in combination.items():
            left[size] -= k * copies
            if not left[size]:
                del left[size]
                order.pop(bisect.bisect_left(order, -size, key=lambda x: -x))
    return plan


def segments(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, pieces a bin, first bin, offset in the bin) in order of rank.

    The distinct lengths of one bin sum to at most the capacity, so there are at most about sqrt(2 * capacity) rows a
    combination, whatever the number of pieces.
    """
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    bin_id = 0
    for combination, copies in plan:
        offset = 0
        for size, k in sorted(combination.items(), reverse=True):
            rows.setdefault(size, []).append((used.get(size, 0), k, bin_id, offset))
            used[size] = used.get(size, 0) + k * copies
            offset += k * size
        bin_id += copies
    return {size: np.array(r, dtype=np.int64) for size, r in rows.items()}


def pack(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    separator: int = SEPARATOR,
    with_ids: bool = False,
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens; one row per piece with its place.

    ``with_ids`` adds the token ids. See the module for nulls, repeated rows and empty tables.
    """
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(tokenized_pieces(docs, tokenizer, capacity, separator, with_ids), "pieces")
    counts = pieces.groupBy("task", "length").count()
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = segments(plan_bins(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    schema = T.StructType(
        [*pieces.drop("task", "rank").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            bins, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at, rows = size == s, table[int(s)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                within = rank[at] - row[:, 0]
                bins[at] = row[:, 2] + within // row[:, 1]
                offset[at] = row[:, 3] + within % row[:, 1] * s
            kept = [batch.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins), pa.array(offset)], names=schema.names)

    return pieces.join(offsets, ["task", "length"]).mapInArrow(place, schema)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))
