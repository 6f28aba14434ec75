"""Personal data: base patterns, and bootstrapped contextual extraction beside them.

1. One pass over whole texts finds the base entities (the seeds) and every other string that may be an identifier, each
   with the lexical patterns around it. Some have a kind's shape; any other word with a few digits or an at sign is open:
   its kind is that of the pattern that finds it. Strings that fail a base pattern's test (card digits that fail Luhn,
   address parts over 255, too few digits) are known negatives and are never discovered.
2. Patterns and instances form a bipartite graph of distinct (kind, pattern, instance) edges. Spark scores it in
   rounds, until no confidence rises: a pattern's confidence is the mean score of its instances if enough different
   seeds support it; an unseen instance's score is the noisy-or of its confident patterns.
3. Unseen instances in a confident pattern, with a high score themselves, are added to the spans.

Every round is written to the shared folder; edges are pre-aggregated, so copies of a document add nothing and a
frequent pattern is split by the join's own skew handling. Joins with patterns and instances, which grow with the
input, are merge joins.

Defined results: null text is the empty text. A null ``doc_id`` stays null, repeated rows stay repeated, an empty table
gives an empty result. Ties of a span between kinds are kept, one span a kind. Other columns are ignored by
``personal_data`` and kept by ``redact``.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import Scratch, slices

KINDS = ("email", "ip", "card", "phone")
#: Different seeds that a pattern needs, and the least confidence and score to discover with.
SUPPORT = 5
CONFIDENCE = 0.9
SCORE = 0.8
#: A round in which no confidence rises by more is the last. Scores rise to a limit, so rounds end long before the bound.
RISE, ROUNDS = 0.005, 40

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Shapes of identifiers that the base patterns may miss.
_MAIL_LIKE = re.compile(r"[^\s<>\"',;:()\[\]]+(?:@|\(at\)|\[at\])[^\s<>\"',;:()\[\]]+\.[^\s<>\"',;:()\[\].]{2,}")
_COLON_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_NUMBER = re.compile(r"(?<![\w.+-])[(]?[0-9][0-9\x20().-]{5,}[0-9](?![\w])")
# Any other: a word of 5 to 64 characters, without marks around it, with an at sign or four digits.
_OPEN = re.compile(r"(?<![^\s(\[<\"':;,=])[^\s()\[\]<>\"':;,=][^\s()\[\]<>\"',;=]{3,62}[^\s()\[\]<>\"'.,;:!?=]")
_FOUR_DIGITS = re.compile(r"[0-9](?:[^0-9]*[0-9]){3}")
OPEN = -1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _valid_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in s.split("."))


def _valid_card(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def _valid_phone(s: str) -> bool:
    return 8 <= sum(c.isdigit() for c in s) <= 15


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the base entities, and of the matches that failed their kind's test."""
    found, failed = [], []
    if "@" in text:
        found += [(0, m.start(), m.end()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern, test in ((1, _IP, _valid_ip), (2, _CARD, _valid_card), (3, _PHONE, _valid_phone)):
            for m in pattern.finditer(text):
                if test(m[0]):
                    found.append((kind, m.start(), m.end()))
                elif kind != 2 or 16 <= sum(c.isdigit() for c in m[0]) <= 19:
                    failed.append((kind, m.start(), m.end()))
    return found, failed


def shaped(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of strings with an identifier's shape."""
    if "@" in text or "at" in text and ("(at)" in text or "[at]" in text):
        for m in _MAIL_LIKE.finditer(text):
            yield 0, m.start(), m.end()
    if ":" in text:
        for m in _COLON_IP.finditer(text):
            yield 1, m.start(), m.end()
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if 12 <= n <= 19:
                yield 2, m.start(), m.end()
            if 7 <= n <= 15:
                yield 3, m.start(), m.end()


def open_words(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of words that may be identifiers of any kind."""
    if _FOUR_DIGITS.search(text) or "@" in text:
        for m in _OPEN.finditer(text):
            if "@" in m[0] or _FOUR_DIGITS.search(m[0]):
                yield m.start(), m.end()


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a string: three words before it; two before and one after it.

    Words are in lower case with digits as 0; "^" stands before the start of the text. A pattern needs a cue, a word of
    five or more letters or one that ends in a colon or equals sign; function words alone are none.
    """
    near = text[max(0, start - 120) : start]
    before = [_DIGIT.sub("0", w.lower()[-24:]) for w in near.split()[-3:]]
    if len(near) == start:
        before = ["^"] * (3 - len(before)) + before
    after = [_DIGIT.sub("0", w.lower()[:24]) for w in text[end : end + 60].split()[:1]]
    out = []
    if len(before) == 3:
        out.append((before, "<"))
    if len(before) >= 2 and after:
        out.append((before[-2:] + after, "<>"))
    return [f"{mark} {' '.join(ws)}" for ws, mark in out if any(len(w) >= 5 or w[-1] in ":=" for w in ws)]


SPAN = "struct<kind:int,start:int,stop:int>"
SEEN = "struct<kind:int,start:int,stop:int,state:int,instance:string,patterns:array<string>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
_SEEN = pa.struct([*_SPAN, ("state", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])


def scan_text(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans, and all instances with their patterns; state 1 seed, 0 unseen, -1 negative."""
    found, failed = base_spans(text)
    spans = [{"kind": k, "start": s, "stop": e} for k, s, e in sorted(found)]
    seen = []

    def add(kind: int, start: int, stop: int, state: int) -> None:
        made = patterns(text, start, stop)
        if made:
            seen.append({"kind": kind, "start": start, "stop": stop, "state": state, "instance": text[start:stop].lower(), "patterns": made})

    for kind, s, e in found:
        add(kind, s, e, 1)
    for kind, s, e in failed:
        add(kind, s, e, -1)
    # What is taken already, as stretches that do not overlap: one look-up a candidate, also in a text full of numbers.
    taken = Stretches((s, e) for _, s, e in found + failed)
    free = [x for x in shaped(text) if not taken.overlaps(x[1], x[2])]
    for kind, s, e in free:
        add(kind, s, e, 0)
    shapes = Stretches((s, e) for _, s, e in free)
    for s, e in open_words(text):
        if not taken.overlaps(s, e) and not shapes.overlaps(s, e):
            add(OPEN, s, e, 0)
    return spans, seen


class Stretches:
    """Stretches of a text, overlapping ones as one."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.stops: list[int] = []
        for s, e in sorted(spans):
            if self.stops and s < self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], e)
            else:
                self.starts.append(s)
                self.stops.append(e)

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end) - 1
        return k >= 0 and self.stops[k] > start


def scan(docs: DataFrame, text: str, keep: bool) -> DataFrame:
    """``docs`` (without ``text`` unless ``keep``) with a row number, the base spans and the instances of each text."""
    names = [n for n in docs.columns if keep or n != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in slices(batches, text):
            made = [scan_text(t or "") for t in batch.column(text).to_pylist()]
            rids = pa.array(range(at, at + len(made)), pa.int64())
            at += len(made)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    rids,
                    pa.array([m[0] for m in made], pa.list_(_SPAN)),
                    pa.array([m[1] for m in made], pa.list_(_SEEN)),
                ],
                names=[*names, "__rid", "__base", "__seen"],
            )

    schema = T.StructType([*docs.select(*names).schema.fields]).add("__rid", "long")
    schema = schema.add("__base", T._parse_datatype_string(f"array<{SPAN}>")).add("__seen", T._parse_datatype_string(f"array<{SEEN}>"))
    return docs.mapInArrow(run, schema)


def confident(edges: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame] | None:
    """(kind, pattern) that discover and (kind, instance) that are discovered; None when no pattern is confident."""
    score, before = F.when(F.col("state") == 1, 1.0).otherwise(0.0), None
    scored = edges.withColumn("score", score)
    for i in range(rounds):
        made = scored.groupBy("kind", "pattern").agg(F.avg("score").alias("confidence"), F.sum((F.col("state") == 1).cast("int")).alias("seeds"))
        # Only these can rise: under half the confidence, an instance's score stays under one half too.
        good = scratch.write(made.where((F.col("seeds") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE / 2)).select("kind", "pattern", "confidence"), "patterns")
        if good.isEmpty():
            return None
        if i == 0:  # written once it is known that they are needed again
            edges = scratch.write(edges, "edges")
        met = edges.where("state = 0").join(good.hint("merge"), ["kind", "pattern"])
        doubt = F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence"))))
        found = scratch.write(met.groupBy("kind", "instance").agg((1 - F.exp(doubt)).alias("found")), "instances")
        if before is not None:
            old = before.withColumnRenamed("confidence", "old").hint("merge")
            rise = good.join(old, ["kind", "pattern"], "left").agg(F.max(F.col("confidence") - F.coalesce("old", F.lit(0.0)))).first()[0]
            if rise <= RISE:
                break
        before = good
        scored = edges.join(found.hint("merge"), ["kind", "instance"], "left").withColumn("score", F.when(F.col("state") == 0, F.coalesce("found", F.lit(0.0))).otherwise(score))
    return good.where(F.col("confidence") >= CONFIDENCE).select("kind", "pattern"), found.where(F.col("found") >= SCORE).select("kind", "instance")


def discovered(scanned: DataFrame, scratch: Scratch) -> DataFrame | None:
    """__rid and the spans that the method adds to a row; None when it adds none anywhere."""
    seen = scanned.select("__rid", F.inline("__seen"))
    exploded = seen.select("__rid", "kind", "start", "stop", "state", "instance", F.explode("patterns").alias("pattern"))
    # An instance that is a seed anywhere is a seed; one that fails is a negative.
    edges = exploded.groupBy("kind", "pattern", "instance").agg(F.max("state").alias("high"), F.min("state").alias("low"))
    edges = edges.select("kind", "pattern", "instance", F.when(F.col("low") < 0, F.lit(-1)).otherwise(F.col("high")).alias("state"))
    edges = scratch.write(edges, "seen")
    # An open word takes the kinds of the patterns it stands in that have seeds enough.
    seeded = edges.where("state = 1").groupBy("kind", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).drop("n")
    seeded = scratch.write(seeded, "seeded")
    if seeded.isEmpty():
        return None
    kinds = seeded.select(F.col("kind").alias("as"), "pattern").hint("merge")
    open_edges = edges.where(F.col("kind") == OPEN).join(kinds, "pattern").select(F.col("as").alias("kind"), "pattern", "instance", "state")
    # Edges of patterns without seeds play no part.
    own = edges.where(F.col("kind") != OPEN).join(seeded.hint("merge"), ["kind", "pattern"], "left_semi")
    best = confident(own.unionByName(open_edges).distinct(), scratch)
    if best is None:
        return None
    good, instances = best
    unseen = exploded.where("state = 0").withColumnRenamed("kind", "shape").join(good.hint("merge"), "pattern").where((F.col("shape") == F.col("kind")) | (F.col("shape") == OPEN))
    hits = unseen.join(instances.hint("merge"), ["kind", "instance"])
    spans = hits.select("__rid", F.struct("kind", "start", "stop").alias("span")).distinct()
    added = scratch.write(spans.groupBy("__rid").agg(F.collect_list("span").alias("__added")), "added")
    return None if added.isEmpty() else added


def with_added(scanned: DataFrame, scratch: Scratch) -> DataFrame:
    """``scanned`` with ``__added``, an array of spans (empty for most rows)."""
    none = F.array().cast(f"array<{SPAN}>")
    added = discovered(scanned, scratch)
    if added is None:
        return scanned.withColumn("__added", none)
    return scanned.join(added.hint("merge"), "__rid", "left").withColumn("__added", F.coalesce("__added", none))


def redacted(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with each stretch of personal data in ``text`` replaced by its kind; ``__base`` and ``__added`` are its spans."""
    cols = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            spans = zip(batch.column("__base").to_pylist(), batch.column("__added").to_pylist(), strict=True)
            texts = [replace(t, base + added) for t, (base, added) in zip(batch.column(text).to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text else batch.column(n) for n in cols], names=cols)

    return rows.mapInArrow(run, rows.schema)


def personal_data(spark: SparkSession, docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, base (spans of the base patterns) and added (spans of the bootstrapped patterns), as arrays of structs.

    ``with_text`` adds the redacted text.
    """
    scratch = Scratch(spark, "pii")
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    scanned = scratch.write(scan(texts, "text", keep=with_text), "scanned")
    text = ["text"] * with_text
    rows = with_added(scanned, scratch).select("doc_id", *text, "__base", "__added")
    rows = redacted(rows, "text") if with_text else rows
    return rows.select("doc_id", F.col("__base").alias("base"), F.col("__added").alias("added"), *text)


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with each stretch of personal data replaced by its kind in brackets; ``n_chars`` follows the new text."""
    scratch = Scratch(spark, "pii")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"
    n_chars = f"c{names.index('n_chars')}" if "n_chars" in names else None
    scanned = scratch.write(scan(plain.withColumn(text, F.col(text).cast("string")), text, keep=True), "scanned")
    out = redacted(with_added(scanned, scratch).select(*plain.columns, "__base", "__added"), text)
    if n_chars:
        out = out.withColumn(n_chars, F.length(text).cast(plain.schema[n_chars].dataType))
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def replace(text: str | None, spans: list[dict]) -> str | None:
    """The text with each stretch of overlapping spans replaced by the kind of its first."""
    if not text or not spans:
        return text
    out, at, until = [], 0, -1
    for s in sorted(spans, key=lambda s: (s["start"], -s["stop"], s["kind"])):
        if s["start"] >= until:
            out += [text[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
            until = s["stop"]
        until = max(until, s["stop"])
        at = until
    return "".join([*out, text[at:]])


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=True)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.array_sort("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        "text",
    )
