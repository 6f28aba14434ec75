"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. A node has a failure link and the number of pieces popped when it is followed, so that the
greedy longest-match pieces of a word are counted in one pass over its bytes, without backing up and without building
a piece.

A word is a run of characters that are not white space; it is matched as one space and its UTF-8 bytes, which is how
byte-level vocabularies mark a word's start. A word that cannot be covered counts as one unknown piece.

Defined results: null, empty and blank texts have 0 words and 0 tokens. A null ``doc_id`` stays null, repeated rows
stay repeated, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import columns, slices
from factloom.llm.packing import byte_alphabet

#: Words whose counts a worker remembers before it starts anew.
MEMORY = 1 << 18


class LongestMatch:
    """Counts the pieces of greedy longest match. ``goto`` maps node * 256 + byte to a node; node 0 is the root."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.goto: dict[int, int] = {}
        parent, via, ends = [0], [0], {0: False}
        for piece in vocabulary:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.goto:
                    self.goto[key] = len(parent)
                    ends[len(parent)] = False
                    parent.append(node)
                    via.append(byte)
                node = self.goto[key]
            ends[node] = bool(piece)
        #: The failure link, -1 for none, and the pieces popped on the way there.
        self.fail, self.popped = [-1] * len(parent), [0] * len(parent)
        below: dict[int, list[int]] = {}
        for node in range(1, len(parent)):
            below.setdefault(parent[node], []).append(node)
        queue = deque(below.get(0, ()))
        while queue:
            node = queue.popleft()
            queue.extend(below.get(node, ()))
            if ends[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            up = parent[node]
            state, count = self.fail[up], self.popped[up]
            while state >= 0 and (state << 8 | via[node]) not in self.goto:
                count += self.popped[state]
                state = self.fail[state]
            if state >= 0:
                self.fail[node], self.popped[node] = self.goto[state << 8 | via[node]], count

    def count(self, word: bytes) -> int | None:
        """Number of pieces, or None if greedy longest match can't cover the word."""
        goto, fail, popped = self.goto, self.fail, self.popped
        node = total = 0
        for byte in word:
            key = node << 8 | byte
            while key not in goto:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return None
                key = node << 8 | byte
            node = goto[key]
        while node:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return None
        return total


_loaded: dict[str, LongestMatch] = {}


def load(path: str) -> LongestMatch:
    """The automaton over the vocabulary of a byte-level tokenizer file."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens") or []}
        alphabet = byte_alphabet()
        _loaded[path] = LongestMatch(bytes(alphabet[c] for c in t) for t in spec["model"]["vocab"] if t not in special)
    return _loaded[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(vocabulary)
        known: dict[str, int] = {}
        for batch in slices(batches, "text"):
            out: tuple[list[int], ...] = ([], [], [])
            for text in batch.column("text").to_pylist():
                words = (text or "").split()
                tokens = unknown = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        if len(known) >= MEMORY:
                            known.clear()
                        n = automaton.count(b" " + w.encode("utf-8", "surrogatepass")) or 0
                        known[w] = n
                    tokens += n or 1
                    unknown += not n
                for column, value in zip(out, (len(words), tokens, unknown), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out)], names=["doc_id", "n_words", "n_tokens", "n_unknown"]
            )

    texts = columns(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
