"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

A document is the mean of learned vectors of its hashed words (runs of dark bytes, with their case) and of its n-grams
of 3 and 4 characters; a softmax layer follows. Each step goes down the gradient of the cross-entropy, vectors by VECTOR_RATE
times the rate of the layer, since the mean spreads their gradient over all features of a document. At most TRAIN_DOCS
labelled documents of at most TRAIN_BYTES are used, chosen by a hash of their id: a bound that keeps the fit on the driver small at any input size. Since the mean is linear, a trained model is
folded into one number a bucket for scoring, and buckets that training never met count nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import id_crc32, prepare
from .spans import DARK_BYTES, blocks, character_grams, characters, hash_runs, runs

BITS, SIZES, DIM = 18, (3, 4), 8
TRAIN_DOCS, TRAIN_BYTES, EPOCHS, RATE, VECTOR_RATE, SEED = 3000, 1 << 16, 6, 1.0, 40.0, 7
THRESHOLD = 0.3


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = runs(data, offsets, DARK_BYTES)
    return (hash_runs(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int32), first


def buckets(data: np.ndarray) -> np.ndarray:
    """All features of one text."""
    return np.concatenate([word_buckets(data, np.array([0, len(data)]))[0], *(character_grams(characters(data, np.array([0, len(data)]))[0], n, BITS) for n in SIZES)])


class Model:
    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray, met: np.ndarray):
        self.vectors, self.weights, self.bias, self.met = vectors, weights, bias, met

    @classmethod
    def fit(cls, rows: list[tuple[int, str]], epochs: int = EPOCHS, rate: float = RATE, vector_rate: float = VECTOR_RATE) -> Model:
        """rows: (label 0 or 1, text). Without rows every score is one half."""
        rng = np.random.default_rng(SEED)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
        weights, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
        met = np.zeros(1 << BITS, bool)
        docs = []
        for label, text in rows:
            found, counts = np.unique(buckets(np.frombuffer(text.encode(), np.uint8)), return_counts=True)
            met[found] = True
            docs.append((label, found, (counts / max(1, counts.sum())).astype(np.float32)))
        steps, done = epochs * max(1, len(docs)), 0
        for _ in range(epochs):
            for k in rng.permutation(len(docs)):
                label, found, share = docs[k]
                mean = share @ vectors[found]
                logits = weights @ mean + bias
                odds = np.exp(logits - logits.max())
                wrong = odds / odds.sum()
                wrong[label] -= 1
                pace = np.float32(rate * (1 - done / steps))
                back = wrong @ weights
                weights -= pace * np.outer(wrong, mean)
                bias -= pace * 0.02 * wrong
                vectors[found] -= pace * vector_rate * share[:, None] * back
                done += 1
        return cls(vectors, weights, bias, met)

    def folded(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log odds of label 1, and their base."""
        return np.where(self.met, self.vectors @ (self.weights[1] - self.weights[0]), 0).astype(np.float32), float(self.bias[1] - self.bias[0])


def scores(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, base: float) -> np.ndarray:
    """The probability of label 1 for each text of a block."""
    total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)

    def add(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        run = np.zeros(len(values) + 1)
        np.cumsum(values, out=run[1:])
        total[:] += run[np.minimum(high, len(values))] - run[np.minimum(low, len(values))]
        count[:] += high - low

    found, first = word_buckets(data, offsets)
    add(table[found], first[:-1], first[1:])
    chars, offsets = characters(data, offsets)
    for n in SIZES:
        low, high = offsets[:-1], np.maximum(offsets[1:] - n + 1, offsets[:-1])
        add(table[character_grams(chars, n, BITS)], low, high)
    return 1 / (1 + np.exp(-(base + total / np.maximum(count, 1))))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS) -> Model:
    """Fit on labelled rows whose crc32 of the id, mod 5, is not 0. Rows without label or text in either table don't count."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (id_crc32("id") % 5 != 0))
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    chosen = F.broadcast(chosen)  # at most so many rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES).join(chosen, "id").groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text")).collect()
    return Model.fit([(r.label, r.text) for r in sorted(rows, key=lambda r: (r.id, r.text))])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: id_col, score (0 to 1), predicted (1 if score >= threshold). Null texts are empty ones.

    An empty text scores what the model's base says. Repeated rows give repeated rows.
    """
    spark = prepare(docs.sparkSession)
    known = spark.sparkContext.broadcast(model.folded())  # 2**BITS numbers, whatever the input
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        table, base = known.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at, end, data, offsets in blocks(batch.column("text")):
                out[at:end] = scores(data, offsets, table, base)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out), pa.array((out >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
