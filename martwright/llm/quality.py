"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it.  Each byte has a learned vector, each
filter a learned weight for a few bytes in a row; a chunk's feature is the filter's highest response in it,
and a weighted sum of features says how good the chunk looks.  The mean and the least over the chunks give
one probability.  Vectors and filters meet in one table per byte pair, so that scoring only looks up and adds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm.base import bounded_sample, held_out, query, release, slices, table, with_text
from martwright.session import stage

CHUNK_BYTES, STEP_BYTES = 512, 448
VECTOR, FILTERS, WIDTH = 8, 16, 6
#: Learning reads about this many labelled documents of each class, and of each up to so many chunks spread over it.
SAMPLE_DOCS, SAMPLE_CHUNKS = 1000, 4
STEPS, BATCH, RATE, DECAY = 500, 64, 0.01, 1e-4
CHUNKS_AT_ONCE, BYTES_AT_ONCE = 64, 4_000_000
SEED = 7


@dataclass(frozen=True)
class QualityModel:
    """Byte vectors, filters with their offsets, weights of features, and how chunks combine; or only a constant."""

    vectors: np.ndarray
    filters: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray
    combine: np.ndarray
    constant: float | None = None

    def pair_tables(self) -> np.ndarray:
        """Response of each filter to each pair of bytes, at each second place of its width."""
        single = np.einsum("bv,kvf->kbf", self.vectors, self.filters)
        return np.ascontiguousarray((single[0::2, :, None, :] + single[1::2, None, :, :]).reshape(WIDTH // 2, 1 << 16, FILTERS), np.float32)


def starts(size: int) -> list[int]:
    """Where the chunks of a text begin; the last one ends with the text."""
    if size <= CHUNK_BYTES:
        return [0]
    return [*range(0, size - CHUNK_BYTES, STEP_BYTES), size - CHUNK_BYTES]


def chunks(text: bytes, at: list[int]) -> np.ndarray:
    """The chunks that begin at the given places, as rows of bytes; a short text is filled up with zeros."""
    data = np.frombuffer(text.ljust(CHUNK_BYTES, b"\0"), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK_BYTES)[at]


def features(rows: np.ndarray, tables: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Highest response of each filter in each chunk."""
    out = np.empty((len(rows), FILTERS), np.float32)
    for at in range(0, len(rows), CHUNKS_AT_ONCE):
        part = rows[at : at + CHUNKS_AT_ONCE].astype(np.int32)
        pairs = part[:, :-1] * 256 + part[:, 1:]
        places = CHUNK_BYTES - WIDTH + 1
        response = np.take(tables[0], pairs[:, :places], axis=0)
        for k in range(1, len(tables)):
            response += np.take(tables[k], pairs[:, 2 * k : 2 * k + places], axis=0)
        out[at : at + CHUNKS_AT_ONCE] = response.max(axis=1)
    return np.maximum(out + offsets.astype(np.float32), 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


class _Adam:
    def __init__(self, parameters: list[np.ndarray]):
        self.parameters, self.n = parameters, 0
        self.first, self.second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]

    def step(self, gradients: list[np.ndarray], rate: float) -> None:
        self.n += 1
        for p, g, a, b in zip(self.parameters, gradients, self.first, self.second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**self.n)) / (np.sqrt(b / (1 - 0.999**self.n)) + 1e-8)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients (the last is the constant) of a logistic regression, by Newton's method with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ w)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (weight * (p - y)) + 1e-2 * w)
    return w


def _importance(labels: np.ndarray) -> np.ndarray:
    """Weight of each document, so that both classes weigh the same."""
    share = labels.mean()
    return np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))


def fit(rows: np.ndarray, owners: np.ndarray, labels: np.ndarray) -> QualityModel:
    """Learn filters from chunks, the document each is of, and the documents' labels (0 or 1); classes weigh the same."""
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 0.5, (256, VECTOR))
    filters = rng.normal(0, (WIDTH * VECTOR) ** -0.5, (WIDTH, VECTOR, FILTERS))
    offsets, weights, constant = np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS), np.zeros(1)
    none = QualityModel(vectors, filters, offsets, np.append(weights, 0), np.zeros(3), 0.5)
    if not len(labels):
        return none
    if labels.min() == labels.max():
        return QualityModel(vectors, filters, offsets, np.append(weights, 0), np.zeros(3), float((labels.sum() + 1) / (len(labels) + 2)))
    importance = _importance(labels)
    target, weight = labels[owners].astype(float), importance[owners]
    adam = _Adam([vectors, filters, offsets, weights, constant])
    places = CHUNK_BYTES - WIDTH + 1
    order = np.concatenate([rng.permutation(len(rows)) for _ in range(-(-STEPS * BATCH // len(rows)))])  # as many steps for any sample
    for step in range(STEPS):
        pick = order[step * BATCH : (step + 1) * BATCH]
        part = rows[pick].astype(np.intp)
        single = np.einsum("bv,kvf->kbf", vectors, filters).astype(np.float32)
        response = single[0][part[:, :places]]
        for k in range(1, WIDTH):
            response += single[k][part[:, k : k + places]]
        top = response.argmax(axis=1)
        pooled = np.take_along_axis(response, top[:, None, :], axis=1)[:, 0] + offsets
        hidden = np.maximum(pooled, 0)
        error = weight[pick] * (_sigmoid(hidden @ weights + constant) - target[pick]) / len(pick)
        through = error[:, None] * weights * (pooled > 0)
        spread = part[np.arange(len(pick))[:, None, None], top[:, :, None] + np.arange(WIDTH)]  # bytes under each filter's best place
        seen = vectors[spread]
        filter_slope = np.einsum("nf,nfkv->kvf", through, seen)
        vector_slope = np.zeros_like(vectors)
        np.add.at(vector_slope, spread, np.einsum("nf,kvf->nfkv", through, filters))
        adam.step([vector_slope + DECAY * vectors, filter_slope + DECAY * filters, through.sum(axis=0), hidden.T @ error + DECAY * weights, error.sum(keepdims=True)],
                  RATE * (1 - step / STEPS))
    return QualityModel(vectors, filters, offsets, np.append(weights, constant), np.zeros(3))


def combine(model: QualityModel, found: np.ndarray, labels: np.ndarray) -> QualityModel:
    """The model with weights for mean and least of a document's chunks, learned from both of all chunks of each document."""
    if model.constant is not None:
        return model
    return replace(model, combine=_logistic(found, labels.astype(float), _importance(labels)))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_chunks: int = SAMPLE_CHUNKS) -> QualityModel:
    """Learn from about ``sample_docs`` labelled documents per class; null labels and others than 0 and 1 are passed over.

    Filters learn from chunks of ``CHUNK_BYTES`` bytes, ``sample_chunks`` a document, spread over its whole
    text; how chunks combine is learned from all chunks of the same documents, of which two numbers a document
    come back.  So the sample's size bounds what reaches the driver.  Without labelled rows every score is one half.
    """
    marked = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1))
    picked = bounded_sample(marked, "_id", "_label", sample_docs, "quality")
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    found = stage(found.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_label"), "quality_sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, parts = [], [], []
            for key, body, kind in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                every = starts(len(body or b""))
                some = sorted(every, key=lambda at, key=key: zlib.crc32(f"{key}:{at}".encode()))[:sample_chunks]
                ids.append(key), kinds.append(kind), parts.append(chunks(body or b"", sorted(some)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "label", "chunks"])

    sample = found.mapInArrow(cut, "doc_id long, label int, chunks binary").toPandas()
    sample = sample.sort_values(["doc_id", "label", "chunks"], ignore_index=True)
    rows = [np.frombuffer(c, np.uint8).reshape(-1, CHUNK_BYTES) for c in sample["chunks"]]
    owners = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    model = fit(np.vstack(rows) if rows else np.zeros((0, CHUNK_BYTES), np.uint8), owners, sample["label"].to_numpy())
    if model.constant is not None:
        return model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, 1, BYTES_AT_ONCE):
            seen = np.array([scorer.logits(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(seen[:, 0]), pa.array(seen[:, 1])], names=["label", "mean", "least"])

    seen = found.mapInArrow(measure, "label int, mean double, least double").toPandas().sort_values(["label", "mean", "least"], ignore_index=True)
    return combine(model, seen[["mean", "least"]].to_numpy(), seen["label"].to_numpy())


class Scorer:
    def __init__(self, model: QualityModel):
        self.model, self.tables = model, model.pair_tables()

    def logits(self, text: bytes) -> tuple[float, float]:
        """Mean and least over all chunks of a text, in blocks of chunks."""
        every, total, least = starts(len(text)), 0.0, np.inf
        for at in range(0, len(every), 4096):
            found = features(chunks(text, every[at : at + 4096]), self.tables, self.model.offsets) @ self.model.weights[:-1] + self.model.weights[-1]
            total, least = total + found.sum(), min(least, found.min())
        return total / len(every), least

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        found = np.array([self.logits(t) for t in texts]).reshape(-1, 2)
        return _sigmoid(found @ self.model.combine[:2] + self.model.combine[2])


def classify(docs: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with ``score`` (0 to 1, higher: label 1 likelier) of every whole text; a null text counts as empty.

    Equal texts have equal scores.  Repeated rows stay; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows, at = with_text(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = Scorer(sent.value)
        for batch in slices(batches, at, BYTES_AT_ONCE):
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scorer.score(texts), pa.float64())], names=[*keep, "score"])

    return rows.mapInArrow(run, docs.select(*keep, F.lit(0.0).alias("score")).schema)


def train_on(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Learn from the labels of the documents that are not held out."""
    return train(docs, labels.where(~held_out()))


@query("op6_quality")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = classify(docs, train_on(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
