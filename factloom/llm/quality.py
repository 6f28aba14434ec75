"""Quality scores by a factorisation machine.

Features of a whole text: its words, hashed, weighted by the root of their counts and scaled to length one; statistics
of its structure and its length, each turned into one of ``BINS`` indicator features at quantiles of the training
sample. Every pair of features interacts through vectors of ``RANK`` numbers. The sum over all pairs is
half of (square of the sum - sum of the squares), so a score takes time linear in the number of features.

Training takes a bounded sample of labelled rows: at most ``SAMPLE``, by a hash of their ids, outside the held-out fold.
Labels, language, source and id are never inputs. Counts and statistics that are scored come from whole texts. Scores
are calibrated: at most ``CALIBRATION`` rows of the sample are scored by machines trained on the other folds, and a
logistic curve through those margins and their labels gives the slope and shift of the machine's own margins.

Defined results: a null text is scored like the empty text. A null ``doc_id`` is never learned from, is not held out
and stays null. Of the texts of a repeated id the least is learned from. Repeated labels of a document count once for each different label; null labels are left out. With
nothing to learn from, every score is 0.5. Repeated rows stay repeated, an empty table gives an empty result and other
columns are ignored.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import columns, fold, slices

WORDS = 1 << 12
BINS = 10
RANK = 6
#: Bound of the training sample.
SAMPLE = 6000
#: Rows of it that scores are calibrated on, in so many folds.
CALIBRATION, FOLDS = 2000, 4
THRESHOLD = 0.3
STATISTICS = (
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "repeated_next", "upper", "digits",
    "punctuation", "marks", "odd_symbols", "log_lines", "distinct_lines", "line_length", "sentence_ends",
    "beyond_ascii", "one_letter_words", "capital_words",
)


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_UPPER, _LOWER, _DIGIT = _bytes_in((65, 90)), _bytes_in((97, 122)), _bytes_in((48, 57))
_PUNCTUATION = _bytes_in((33, 47), (58, 64), (91, 96), (123, 126))
_MARKS, _ODD = np.isin(np.arange(256), list(b"!?")), np.isin(np.arange(256), list(b"#$%&*|=<>{}[]^~@\\"))
_HIGH = _bytes_in((128, 255))


Features = tuple[list[int], list[float], list[float]]


def features(text: str | None) -> Features:
    """Hashed words, their weights, and the statistics."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n_bytes, n_words = max(1, len(data)), max(1, len(words))
    counts = Counter(words)
    hashed: dict[int, int] = {}
    for w, n in counts.items():
        k = zlib.crc32(w) % WORDS
        hashed[k] = hashed.get(k, 0) + n
    norm = math.sqrt(sum(hashed.values())) or 1.0
    share = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    letters = max(1, int(share[_UPPER].sum() + share[_LOWER].sum()))
    lines = [x for x in data.split(b"\n") if x]
    n_lines = max(1, len(lines))
    initials = Counter(w[0] for w in words)
    stats = [
        math.log1p(len(data)),
        math.log1p(len(words)),
        sum(map(len, words)) / n_words,
        len(counts) / n_words,
        max(counts.values(), default=0) / n_words,
        sum(map(operator.eq, words, words[1:])) / n_words,
        share[_UPPER].sum() / letters,
        share[_DIGIT].sum() / n_bytes,
        share[_PUNCTUATION].sum() / n_bytes,
        share[_MARKS].sum() / n_words,
        share[_ODD].sum() / n_words,
        math.log1p(len(lines)),
        len(set(lines)) / n_lines,
        n_words / n_lines,
        share[46] / n_words,
        share[_HIGH].sum() / n_bytes,
        sum(n for w, n in counts.items() if len(w) == 1) / n_words,
        sum(n for b, n in initials.items() if _UPPER[b]) / n_words,
    ]
    return list(hashed), [math.sqrt(n) / norm for n in hashed.values()], [float(s) for s in stats]


@dataclass
class FactorisationMachine:
    edges: np.ndarray  # statistics x (BINS - 1)
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @property
    def n_features(self) -> int:
        return WORDS + len(STATISTICS) * BINS

    @staticmethod
    def rows(edges: np.ndarray, batch: list[Features]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature indices, values, and the first place of each row."""
        index: list[int] = []
        value: list[float] = []
        starts = []
        weight = 1 / math.sqrt(len(STATISTICS))
        stats = np.array([s for _, _, s in batch]).reshape(len(batch), len(STATISTICS))
        bins = np.stack([np.searchsorted(e, stats[:, k], side="right") for k, e in enumerate(edges)], axis=1)
        base = WORDS + BINS * np.arange(len(STATISTICS))
        for (words, weights, _), own in zip(batch, (bins + base).tolist(), strict=True):
            starts.append(len(index))
            index += words
            index += own
            value += weights
            value += [weight] * len(own)
        return np.array(index), np.array(value, dtype=np.float32), np.array(starts)

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score before calibration and the logistic function, and the factor sums of each row."""
        v = self.factors[index] * value[:, None]
        sums = np.add.reduceat(v, starts)
        squares = np.add.reduceat((v * v).sum(axis=1), starts)
        linear = np.add.reduceat(self.linear[index] * value, starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, batch: list[Features]) -> np.ndarray:
        margin, _ = self.margins(*self.rows(self.edges, batch))
        return logistic(self.slope * margin.astype(np.float64) + self.shift)

    @classmethod
    def fit(cls, sample: list[Features], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-4) -> FactorisationMachine:
        """Adagrad on the logistic loss; the seed is fixed."""
        rng = np.random.default_rng(11)
        stats = np.array([s for _, _, s in sample])
        edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        model = cls(edges, 0.0, np.zeros(0), np.zeros(0))
        model.linear = np.zeros(model.n_features, np.float32)
        model.factors = (rng.standard_normal((model.n_features, RANK)) * 0.05).astype(np.float32)
        mean = labels.mean()
        model.bias = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
        g_linear, g_factors, g_bias = np.full_like(model.linear, 1e-2), np.full_like(model.factors, 1e-2), 1e-2
        all_index, all_value, begins = cls.rows(edges, sample)
        sizes = np.diff(np.append(begins, len(all_index)))
        for _ in range(epochs):
            order = rng.permutation(len(sample))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                size = sizes[rows]
                starts = np.cumsum(size) - size
                own = np.arange(size.sum()) + np.repeat(begins[rows] - starts, size)
                index, value = all_index[own], all_value[own]
                margin, sums = model.margins(index, value, starts)
                error = (logistic(margin) - labels[rows]).astype(np.float32) / len(rows)
                per = np.repeat(error, size)
                d_linear = per * value
                d_factors = (per * value)[:, None] * (np.repeat(sums, size, axis=0) - model.factors[index] * value[:, None])
                used, back = np.unique(index, return_inverse=True)
                gl = np.bincount(back, d_linear, len(used)).astype(np.float32) + decay * model.linear[used]
                gf = np.stack([np.bincount(back, d_factors[:, f], len(used)) for f in range(RANK)], axis=1).astype(np.float32) + decay * model.factors[used]
                g_linear[used] += gl * gl
                g_factors[used] += gf * gf
                model.linear[used] -= rate * gl / np.sqrt(g_linear[used])
                model.factors[used] -= rate * gf / np.sqrt(g_factors[used])
                gb = float(error.sum())
                g_bias += gb * gb
                model.bias -= rate * gb / math.sqrt(g_bias)
        return model

    @classmethod
    def fit_calibrated(cls, sample: list[Features], labels: np.ndarray) -> FactorisationMachine:
        """A machine whose scores are calibrated on margins of rows that the machine scoring them did not see."""
        model = cls.fit(sample, labels)
        n = min(len(sample), CALIBRATION)
        part = np.arange(n) % FOLDS
        if min(len(set(labels[:n][part != k].tolist())) for k in range(FOLDS)) < 2:
            return model
        margins = np.zeros(n)
        for k in range(FOLDS):
            own = np.nonzero(part == k)[0]
            other = cls.fit([sample[i] for i in np.nonzero(part != k)[0]], labels[:n][part != k])
            margins[own] = other.margins(*cls.rows(other.edges, [sample[i] for i in own]))[0]
        model.slope, model.shift = calibration(margins, labels[:n])
        return model


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibration(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through margins and labels, by damped Newton steps.

    Labels count as (n + 1) / (n + 2) of their class, so a clean cut gives a finite slope.
    """
    ones = labels.sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    w = np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - target * z))

    now = loss(w)
    for _ in range(steps):
        p = logistic(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2), x.T @ (p - target))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if size <= 1e-6 or before - now < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> FactorisationMachine | None:
    """A machine from at most ``limit`` labelled documents outside the held-out fold; None if there are none."""
    rows = columns(labels, doc_id="doc_id", quality="quality").where("quality IS NOT NULL").distinct()
    rows = rows.where(fold(F.col("doc_id")) != 0)
    # At most ``limit`` rows of two numbers: bounded by the parameter. One text an id and label, however often an id is
    # repeated.
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    texts = columns(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    texts = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("quality").cast(pa.int32()),
                    *(pa.array([m[k] for m in made], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.float64(), pa.float64()))),
                ],
                names=["doc_id", "quality", "words", "weights", "stats"],
            )

    schema = "doc_id long, quality int, words array<int>, weights array<double>, stats array<double>"
    made = texts.mapInArrow(run, schema).toArrow()
    if made.num_rows == 0:
        return None
    order = np.lexsort((made["quality"].to_numpy(), made["doc_id"].to_numpy()))
    words, weights, stats, y = (made[c].to_pylist() for c in ("words", "weights", "stats", "quality"))
    order = order[np.random.default_rng(7).permutation(len(order))]  # any stretch is a sample of all
    sample = [(words[i], weights[i], stats[i]) for i in order]
    return FactorisationMachine.fit_calibrated(sample, np.array([float(y[i] > 0) for i in order]))


def quality(docs: DataFrame, model: FactorisationMachine | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            scores = model.scores([features(t) for t in texts]) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    texts = columns(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality(docs, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
