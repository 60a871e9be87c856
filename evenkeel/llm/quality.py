"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal updates."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import ngrams
from evenkeel.llm.common import chosen, sliced

#: Labelled documents the model learns from at most, by hash of the id, and passes over them.
FIT_ROWS = 8_000
EPOCHS = 4
#: Hashed features.
WIDTH = 1 << 18
_PIECES = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Pieces(dict):
    """Hashes of the letter runs, digit runs and symbol runs of a token."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= ngrams.MEMORY:
            self.clear()
        found = tuple(xxhash.xxh64_intdigest(p.encode()) for p in _PIECES.findall(token))
        if len(token) < 100:
            self[token] = found
        return found


def features(texts: list[str], memory: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Places of all single pieces and pairs, and how many there are per text."""
    hashes = [[h for token in t.split() for h in memory[token]] for t in texts]
    sizes = np.fromiter(map(len, hashes), np.int64, len(texts))
    flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(sizes.sum()))
    row = np.repeat(np.arange(len(texts)), sizes)
    inner = row[1:] == row[:-1]
    pairs = ngrams.spread(flat[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + flat[1:])[inner]
    places = np.concatenate((flat, pairs)) % np.uint64(WIDTH)
    rows = np.concatenate((row, row[:-1][inner] if len(row) else row))
    order = np.argsort(rows, kind="stable")
    return places[order].astype(np.int64), np.bincount(rows, minlength=len(texts))


class Ftrl:
    """Follow the regularised leader with per-coordinate rates; the last coordinate is the bias."""

    def __init__(self, width: int, alpha=0.3, beta=1.0, l1=0.02, l2=0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(width + 1), np.zeros(width + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ x) - label) * x
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights from ``labels`` (doc_id, label 0/1) and the texts of ``docs``.

    Labels that are null teach nothing; of several labels of an id the largest counts. Features
    are made where the texts are; one task then sees the bounded sample in hash order.
    """
    picked = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def made(batches):
        memory = Pieces()
        for batch in sliced(batches, "text"):
            places, sizes = features([t or "" for t in batch.column("text").to_pylist()], memory)
            ends = np.cumsum(sizes)
            packed = []
            for a, b in zip(ends - sizes, ends):
                at, n = np.unique(places[a:b], return_counts=True)
                packed.append(np.stack((at, n)).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("label"), pa.array(packed, pa.binary())], ["order", "label", "x"])

    def learned(batches):
        model, rows = Ftrl(WIDTH), []
        for batch in batches:
            for label, data in zip(batch.column("label").to_pylist(), batch.column("x").to_pylist()):
                at, n = np.frombuffer(data, np.int32).reshape(2, -1)
                rows.append((np.append(at, WIDTH), np.append(n / np.sqrt(max(n.sum(), 1)), 1.0), label))
        for _ in range(EPOCHS):
            for row in rows:
                model.learn(*row)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], ["weights"])

    order = F.xxhash64("doc_id", "text").alias("order")
    sample = chosen(docs.select("doc_id", "text"), picked, "doc_id").select(order, "text", F.col("label").cast("int").alias("label"))
    ready = sample.mapInArrow(made, "order long, label int, x binary").repartition(1).sortWithinPartitions("order", "label")
    found = ready.mapInArrow(learned, "weights binary").collect()
    return np.frombuffer(bytes(found[0].weights), np.float32) if found else np.zeros(WIDTH + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) for each row of ``docs``; a null text counts as empty and gets the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w, memory = shared.value.astype(np.float64), Pieces()
        for batch in sliced(batches, "text"):
            places, sizes = features([t or "" for t in batch.column("text").to_pylist()], memory)
            dots = np.concatenate(([0.0], np.cumsum(w[places])))
            ends = np.cumsum(sizes)
            raw = (dots[ends] - dots[ends - sizes]) / np.sqrt(np.maximum(sizes, 1)) + w[WIDTH]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(raw))], ["doc_id", "score"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")
