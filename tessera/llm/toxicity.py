"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score on hashed features of its
words and word beginnings; the document's score is their noisy-or, 1 - prod(1 - p). Only document
labels are needed to train; the sentence scores then locate what is offensive.

The classifier is fitted on at most ``sample`` labelled documents (those with the smallest seeded
hash of doc_id, so the choice does not depend on the data's layout) and at most ``most_bytes`` of
their text in that order. It is trained in one executor task, whose input is bounded by both;
only the weights, a vector of fixed size, reach the driver. Scoring reads every whole text.

Defined results: null, empty or word-less text scores 0. Labels with a null doc_id or a null mark
are not used; a document labelled both ways counts as toxic; of rows that repeat a labelled doc_id
the one with the smallest text hash is learned. Without labels of both kinds every score is 0.
Repeated documents are scored row by row. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import RangeHashes, arrow_map, discard, list_array, materialize

DIMENSIONS = 1 << 18
#: Most labelled documents that the classifier is fitted on.
SAMPLE = 8000
#: Most bytes of their texts.
SAMPLE_BYTES = 64 << 20
THRESHOLD = 0.7
#: Lengths, in bytes of UTF-8, of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*")

_LETTER = np.ones(256, dtype=bool)
_LETTER[:128] = [chr(i).isalnum() for i in range(128)]
_STOP = np.zeros(256, dtype=np.int64)
_STOP[[ord(c) for c in ".!?\n"]] = 1


def sentence_features(text: str | None, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, sentence) index pairs by sentence; sentences without a word are not counted."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _LETTER[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
    sentence = np.cumsum(_STOP[data])[starts]
    sentence = np.cumsum(np.diff(sentence, prepend=sentence[0]) > 0)
    lows, highs, owners = [starts], [ends], [sentence]
    for n in BEGINNINGS:
        longer = ends - starts > n
        lows.append(starts[longer])
        highs.append(starts[longer] + n)
        owners.append(sentence[longer])
    low, high = np.concatenate(lows), np.concatenate(highs)
    owner, hashes = np.concatenate(owners), RangeHashes(data, starts)
    feature = (hashes(low, high) % np.uint64(dimensions)).astype(np.int64)
    both = np.unique(owner * dimensions + feature)  # a word counts once in a sentence
    return (both % dimensions).astype(np.int32), (both // dimensions).astype(np.int32)


@dataclass
class Model:
    """Weights of the features, the last being the bias."""

    weights: np.ndarray

    def sentences(self, features: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Log-odds of each sentence."""
        n = int(owner[-1]) + 1 if len(owner) else 0
        return np.bincount(owner, self.weights[features], n) + self.weights[-1]

    def score(self, text: str | None) -> float:
        features, owner = sentence_features(text, len(self.weights) - 1)
        return float(-np.expm1(-np.logaddexp(0, self.sentences(features, owner)).sum())) if len(owner) else 0.0


def _told_apart(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimensions: int, least: int, score: float) -> np.ndarray:
    """Features that ``least`` documents have and whose toxic share is ``score`` standard errors off the mean."""
    has, toxic = np.zeros(dimensions), np.zeros(dimensions)
    for (features, _), y in zip(bags, labels, strict=True):
        own = np.unique(features)
        has[own] += 1
        toxic[own] += y
    mean = labels.mean()
    return (has >= least) & (np.abs(toxic - has * mean) > score * np.sqrt(has * mean * (1 - mean)))


def _flatten(bags: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, their sentences counted over all bags, and each sentence's bag."""
    counts = [n for _, _, n in bags]
    base = np.concatenate([[0], np.cumsum(counts)[:-1]])
    owner = np.concatenate([o + b for (_, o, _), b in zip(bags, base, strict=True)])
    return np.concatenate([f for f, _, _ in bags]), owner, np.repeat(np.arange(len(bags)), counts)


def train(
    bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimensions: int = DIMENSIONS, epochs: int = 30, batch: int = 128,
    rate: float = 1.0, decay: float = 2e-6, least: int = 4, apart: float = 3.0, positive: float = 3.0,
) -> Model:
    """Noisy-or likelihood by AdaGrad on mini-batches in a seeded order; ``positive`` weighs toxic documents."""
    weights = np.zeros(dimensions + 1)
    weights[-1] = -5.0
    filled = [i for i, (f, _) in enumerate(bags) if len(f)]
    bags, labels = [bags[i] for i in filled], np.asarray(labels)[filled]
    if not len(labels) or labels.min() == labels.max():
        return Model(np.concatenate([np.zeros(dimensions), [-np.inf]]))
    useful = _told_apart(bags, labels, dimensions, least, apart)
    cut = [(f[useful[f]], o[useful[f]], int(o[-1]) + 1) for f, o in bags]
    squares = np.full(dimensions + 1, 1e-2)
    rng = np.random.Generator(np.random.PCG64(10))
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for low in range(0, len(order), batch):
            part = order[low : low + batch]
            features, owner, doc = _flatten([cut[i] for i in part])
            y = labels[part]
            z = np.bincount(owner, weights[features], len(doc)) + weights[-1]
            total = np.maximum(np.bincount(doc, np.logaddexp(0, z), len(part)), 1e-9)
            pull = np.where(y == 1, -positive / np.expm1(np.minimum(total, 500)), 1.0)
            slope = pull[doc] / (1 + np.exp(-np.clip(z, -50, 50))) / len(part)
            touched, at = np.unique(features, return_inverse=True)
            grad = np.bincount(at, slope[owner], len(touched)) + decay * weights[touched]
            squares[touched] += grad**2
            weights[touched] -= rate * grad / np.sqrt(squares[touched])
            grad = slope.sum()
            squares[-1] += grad**2
            weights[-1] -= rate * grad / np.sqrt(squares[-1])
    return Model(weights)


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learned: crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on a bounded, seeded sample of the labelled documents outside the held-out fold."""
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max("toxic").alias("mark"))
        .orderBy(F.xxhash64("id", F.lit(10)), "id").limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("id")).select("id", "mark", "text", F.xxhash64("text").alias("_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("_bytes"))
    texts = materialize(texts)
    # One row per label, then a running sum over at most ``sample`` rows.
    rows = texts.groupBy("id").agg(F.min(F.struct("_hash", "_bytes")).alias("r")).select("id", "r._hash", "r._bytes")
    upto = F.sum("_bytes").over(Window.orderBy(F.xxhash64("id", F.lit(10)), "id"))
    rows = rows.withColumn("_upto", upto).where(F.col("_upto") <= most_bytes).select(F.col("id").alias("_id"), F.col("_hash").alias("_chosen"))
    chosen = texts.join(F.broadcast(rows), F.expr("id = _id AND _hash <=> _chosen")).select("id", "mark", "text")

    def extract(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [sentence_features(t.as_py(), dimensions) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), list_array([f for f, _ in found], pa.int32()), list_array([o for _, o in found], pa.int32())],
            ["id", "mark", "features", "owner"],
        )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: dict[int, tuple] = {}
        for batch in batches:
            for i, mark, features, owner in zip(*batch.columns, strict=True):
                bags[i.as_py()] = (mark.as_py(), features.values.to_numpy().copy(), owner.values.to_numpy().copy())
        order = sorted(bags)
        model = train([bags[i][1:] for i in order], np.array([bags[i][0] for i in order]), dimensions)
        yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights.tobytes()], pa.binary())})

    bags = materialize(arrow_map(chosen, extract, "id bigint, mark int, features array<int>, owner array<int>"))
    found = bags.repartition(1).mapInArrow(learn, "weights binary").collect()  # one row of fixed size
    discard(texts, bags)
    return Model(np.frombuffer(found[0].weights)) if found else train([], np.empty(0), dimensions)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vector of fixed size

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        value = [shared.value.score(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    scored = arrow_map(rows, run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, sentence, score) of the sentences whose own score reaches the threshold.

    start and end are code points of the whole text, end exclusive.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for m in _SENTENCE.finditer(text or ""):
                p = shared.value.score(m[0]) if m[0] else 0.0
                if p >= threshold:
                    rows.append((doc_id, m.start(), m.end(), m[0], p))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "end", "sentence", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return arrow_map(rows, run, "doc_id bigint, start bigint, end bigint, sentence string, score double")


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text the trained classifier does not reject; all columns as they were."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array([shared.value.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, run, columns)
