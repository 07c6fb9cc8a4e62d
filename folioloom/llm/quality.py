"""Quality classifier: supervised subword embeddings.

A word is the mean of the learned vectors of its hashed features (the word itself and its character n-grams), a
document the mean of its words, the output a softmax over two classes; numpy learns all of it by stochastic
gradient descent on a bounded sample of labelled rows. Means and output are linear up to the softmax, so at
scoring time a word is one number, kept for the words that repeat, and a document's log odds are their mean.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folioloom.llm.labelled import fold_of, sample

#: At most so many labelled rows are learned from; features are hashed into so many vectors of so many numbers.
FIT_ROWS, BUCKETS, DIM, EPOCHS = 6_000, 1 << 14, 8, 6
_KEEP = 300_000  # words whose number a task keeps


def word_features(word: bytes, again: bool) -> list[int]:
    """Buckets of the word, of its n-grams of 3 and 4 bytes with ends marked, and of its being the word before."""
    m = b"<" + word + b">"
    out = [crc32(m) % BUCKETS]
    out += [crc32(m[i : i + 3]) % BUCKETS for i in range(len(m) - 2)]
    out += [crc32(m[i : i + 4]) % BUCKETS for i in range(len(m) - 3)]
    if again:
        out += [crc32(b"\0again") % BUCKETS] * len(out)
    return out


def bag(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of a document with their shares, which sum to 1; at most BUCKETS of them."""
    words = (text or b"").split()
    total = np.zeros(BUCKETS)
    for (w, again), n in Counter(zip(words, (a == b for a, b in zip(words, [b"", *words])))).items():
        found = word_features(w, again)
        np.add.at(total, found, n / len(found))
    at = np.flatnonzero(total)
    return at.astype(np.uint16), (total[at] / max(1, len(words))).astype(np.float32)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
            at, share = bag(text)
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary())], ["label", "at", "share"])


@dataclass(frozen=True)
class Model:
    """weight: log odds of class 1 for each feature; bias: of a document without words."""

    weight: np.ndarray
    bias: float


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, rate: float = 4.0, seed: int = 5) -> Model:
    """Stochastic gradient descent over small batches, the rate falling to 0; vectors start small, outputs at 0.
    Classes are weighed as they come."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    bias = np.log(np.array([1 - share, share], np.float32))
    step, size = 0, 16
    steps = max(1, epochs * -(-len(y) // size))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), size):
            some = order[k : k + size]
            lr = rate * (1 - step / steps)
            step += 1
            at = np.concatenate([bags[i][0] for i in some]).astype(np.int64)
            part = np.concatenate([bags[i][1] for i in some])[:, None]
            of = np.repeat(np.arange(len(some)), [len(bags[i][0]) for i in some])
            docs = np.zeros((len(some), DIM), np.float32)
            np.add.at(docs, of, vectors[at] * part)
            p = np.exp((z := docs @ out + bias) - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back = p @ out.T
            np.add.at(vectors, at, -lr * len(some) * part * back[of])
            out -= lr * docs.T @ p
            bias -= 0.05 * lr * p.sum(0)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, label: str = "quality", text: str = "text", doc_id: str = "doc_id", rows: int = FIT_ROWS) -> Model:
    """Learn from at most `rows` labelled documents that are not held out. Without any, every score is 0.5."""
    known = sample(docs, labels, label, folds, held_out, rows, text, doc_id)
    known = known.select(F.col("text").cast("binary").alias("text"), "label")
    got = known.mapInArrow(_bags, "label int, at binary, share binary").collect()
    if not got:
        return Model(np.zeros(BUCKETS), 0.0)
    got.sort(key=lambda r: (bytes(r["at"]), bytes(r["share"]), r["label"]))  # the same order on every run
    bags = [(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["share"], np.float32)) for r in got]
    return train(bags, np.array([min(1, max(0, r["label"])) for r in got]))


class _Words(dict):
    """The log odds of words, worked out when first met."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight = weight.tolist()
        self.again = self.weight[crc32(b"\0again") % BUCKETS]

    def __missing__(self, word: bytes) -> float:
        found = word_features(word, False)
        self[word] = out = sum(self.weight[i] for i in found) / len(found)
        return out


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(model.weight)
        for batch in batches:
            odds = []
            for text in batch["text"].to_pylist():
                words = (text or b"").split()
                values = list(map(known.__getitem__, words))
                # a word that repeats the one before is half its own features, half the mark of repetition
                extra = sum((known.again - v) / 2 for v, a, b in zip(values[1:], words, words[1:]) if a == b)
                odds.append(model.bias + (sum(values) + extra) / max(1, len(words)))
                if len(known) > _KEEP:
                    known.clear()
            keep = [n for n in batch.schema.names if n != "text"]
            score = 1 / (1 + np.exp(-np.clip(np.array(odds, dtype=float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in keep), pa.array(score)], [*keep, "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of docs as struct `row`, with score in 0 to 1. Null and empty texts get the score of the bias; rows that
    repeat are scored as often as they stand, equal texts alike; an empty table gives an empty table. Columns of docs
    may have any names: they stay in `row`."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_scores(model), StructType([rows.schema["row"], StructField("score", DoubleType())]))


def held_out(doc_id: str, folds: int = 3, rest: int = 1):
    return fold_of(F.col(doc_id), folds) == rest
