"""Language identification by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes, all of them. Bytes are embedded, filters of several
widths slide over a window, each is pooled to its maximum, and a softmax over the learned languages follows. A text's
probabilities are the means over its windows, weighted by their bytes.

Because embedding and filters are linear, applying them is one table look-up per filter offset and byte.

Training takes a bounded sample: of the ``LANGUAGES`` most frequent languages at most ``PER_LANGUAGE`` documents each, by
a hash of their ids, and at most ``PER_DOCUMENT`` evenly spread windows of each. Everything that is predicted is predicted from whole texts.

Defined results: null texts and texts without a letter get ``und`` with score 0; so does every row when there is
nothing to learn from. A null ``doc_id`` is never learned from, is not held out and stays null. Rows with a null
language aren't learned from. Repeated rows stay repeated; an empty table gives an empty result. Other columns stay as
they are, but for earlier ``lang_pred`` and ``lang_score``, which are replaced. Languages beyond the ``LANGUAGES`` most
frequent ones are never predicted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import columns, fold, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
#: Bounds of the training sample.
PER_LANGUAGE = 300
PER_DOCUMENT = 6
LANGUAGES = 256
SALTS = 64
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows(data: bytes) -> np.ndarray:
    """All windows of the bytes as rows; the last is filled up with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class ByteConvNet:
    """Softmax over max-pooled filters. Filters of all widths share one kernel that is zero beyond a filter's width."""

    labels: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    kernel: np.ndarray  # (widest * EMBEDDING) x all filters
    bias: np.ndarray
    out: np.ndarray  # all filters x labels
    out_bias: np.ndarray

    @staticmethod
    def mask() -> np.ndarray:
        rows = np.repeat(np.arange(max(WIDTHS)), EMBEDDING)[:, None]
        return (rows < np.repeat(WIDTHS, FILTERS)[None, :]).astype(np.float32)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 5, batch: int = 64, rate: float = 0.01) -> ByteConvNet:
        """Adam on the mean cross-entropy; the seed is fixed, so equal samples give equal networks."""
        rng = np.random.default_rng(7)
        mask, wide = cls.mask(), max(WIDTHS)
        n_filters = mask.shape[1]

        def normal(rows: int, cols: int, scale: float) -> np.ndarray:
            return (rng.standard_normal((rows, cols)) * scale).astype(np.float32)

        p = [
            normal(256, EMBEDDING, 0.5),
            normal(mask.shape[0], n_filters, 0.3) * mask,
            np.zeros(n_filters, np.float32),
            normal(n_filters, len(labels), 0.3),
            np.zeros(len(labels), np.float32),
        ]
        first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        step = 0
        offsets = np.arange(wide)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                xb, n = x[rows], len(rows)
                emb = p[0][xb]
                columns_ = np.lib.stride_tricks.sliding_window_view(emb, wide, axis=1).transpose(0, 1, 3, 2)
                conv = columns_.reshape(n, WINDOW - wide + 1, -1) @ p[1] + p[2]
                best = conv.argmax(axis=1)
                pooled = np.take_along_axis(conv, best[:, None, :], axis=1)[:, 0]
                active = np.maximum(pooled, 0)
                logits = active @ p[3] + p[4]
                prob = np.exp(logits - logits.max(axis=1, keepdims=True))
                prob /= prob.sum(axis=1, keepdims=True)
                d = prob
                d[np.arange(n), y[rows]] -= 1
                d /= n
                d_pool = (d @ p[3].T) * (pooled > 0)
                where = best[:, :, None] + offsets  # n x filters x wide
                seen = xb[np.arange(n)[:, None, None], where]
                picked = p[0][seen].reshape(n, n_filters, -1)
                g_kernel = np.einsum("nfk,nf->kf", picked, d_pool) * mask
                g_emb = np.zeros_like(p[0])
                back = (d_pool[:, :, None] * p[1].T[None]).reshape(-1, EMBEDDING)
                np.add.at(g_emb, seen.ravel(), back)
                step += 1
                grads = [g_emb, g_kernel, d_pool.sum(axis=0), active.T @ d, d.sum(axis=0)]
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return cls(labels, *[a.astype(np.float32) for a in p])

    def tables(self) -> list[np.ndarray]:
        """What byte b adds to each filter at offset j."""
        return [np.ascontiguousarray(self.embedding @ self.kernel[j * EMBEDDING : (j + 1) * EMBEDDING]) for j in range(max(WIDTHS))]

    def predict(self, x: np.ndarray, tables: list[np.ndarray], chunk: int = 128) -> np.ndarray:
        """Probabilities of each window."""
        out = np.empty((len(x), len(self.labels)), dtype=np.float32)
        last = WINDOW - max(WIDTHS) + 1
        for at in range(0, len(x), chunk):
            part = x[at : at + chunk]
            conv = tables[0][part[:, :last]]
            for j in range(1, len(tables)):
                conv += tables[j][part[:, j : j + last]]
            logits = np.maximum(conv.max(axis=1) + self.bias, 0) @ self.out + self.out_bias
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[at : at + chunk] = prob / prob.sum(axis=1, keepdims=True)
        return out


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, per_document: int = PER_DOCUMENT) -> ByteConvNet | None:
    """A network from the documents outside the held-out fold that have a language; None if there are none."""
    rows = columns(docs, doc_id="doc_id", text="text", lang="lang").where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.where(fold(F.col("doc_id")) != 0)
    ids = rows.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id"))
    common = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    ids = ids.join(F.broadcast(common), "lang")
    # Ids alone are ranked, first within a language's salts and then within the language, so no task gets more than
    # SALTS * per_language rows however many documents a language has.
    for keys in (["lang", F.pmod("h", F.lit(SALTS))], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))
        ids = ids.withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank")
    # At most LANGUAGES * per_language rows of an id and a language are sent to all tasks.
    picked = rows.join(F.broadcast(ids.drop("h")), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if _LETTER.search(text):
                    w = windows(text.encode("utf-8", "surrogatepass"))
                    for k in np.unique(np.linspace(0, len(w) - 1, per_document).astype(int)):
                        langs.append(lang)
                        parts.append(w[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["lang", "bytes"])

    sample = sorted((r["lang"], bytes(r["bytes"])) for r in picked.select("lang", "text").mapInArrow(cut, "lang string, bytes binary").collect())
    if not sample:
        return None
    labels = sorted({lang for lang, _ in sample})
    x = np.frombuffer(b"".join(data for _, data in sample), dtype=np.uint8).reshape(-1, WINDOW)
    y = np.array([labels.index(lang) for lang, _ in sample])
    return ByteConvNet.fit(x, y, labels)


def identify(docs: DataFrame, net: ByteConvNet | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` from the whole texts; columns of these names are replaced."""
    names = [n for n in docs.columns if n not in ("lang_pred", "lang_score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else []
        for batch in slices(batches, text, 1 << 20):
            texts = batch.column(text).to_pylist()
            pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if net and t and _LETTER.search(t)]
            if at:
                data = [texts[i].encode("utf-8", "surrogatepass") for i in at]
                parts = [windows(d) for d in data]
                prob = net.predict(np.concatenate(parts), tables).astype(np.float64)
                size = np.concatenate([[WINDOW] * (len(w) - 1) + [len(d) - WINDOW * (len(w) - 1)] for w, d in zip(parts, data, strict=True)])
                starts = np.cumsum([0, *[len(w) for w in parts[:-1]]])
                mean = np.add.reduceat(prob * size[:, None], starts) / np.add.reduceat(size, starts)[:, None]
                for i, row in zip(at, mean, strict=True):
                    k = int(row.argmax())
                    pred[i], score[i] = net.labels[k], min(1.0, float(row[k]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "lang_score"]
            )

    return docs.select(*[docs[f"`{n}`"] for n in names]).mapInArrow(run, docs.select(*[docs[f"`{n}`"] for n in names]).schema.add("lang_pred", "string").add("lang_score", "double"))


def keep_languages(docs: DataFrame, net: ByteConvNet | None, least: float = 0.3) -> DataFrame:
    """The rows whose language is known with a score of at least ``least``, with their columns as they were."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"
    kept = identify(plain, net, text).where((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= least))
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", F.col("lang_score").alias("score"))
