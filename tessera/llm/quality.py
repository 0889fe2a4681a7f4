"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text's features are its words and word shapes (letter case, digits and marks, runs shortened), alone and in pairs of
neighbours, each as a share of the text's words. A score is the logistic of the sparse dot product with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.frames import once, quoted

#: What a byte looks like: letters by case, digits, and any other ASCII character itself.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("a") : ord("z") + 1] = ord("a")
SHAPE[0x80:] = ord("a")
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("0") : ord("9") + 1] = ord("0")
#: Hashes that stand for the start of a text and for a word that repeats the one before (fixed values).
START, REPEAT = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
KINDS = 5
SCALE = 8.0


@dataclass
class Settings:
    """``max_rows`` bounds the labelled rows that the fit uses: the ones whose hashed ids come first."""

    bits: int = 18
    max_rows: int = 6000
    epochs: int = 4
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.2
    l2: float = 0.5


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int


def shapes(words: W.Words) -> np.ndarray:
    """A hash of each word's shape: runs of the same kind of character count once."""
    looks = SHAPE[words.data]
    keep = np.ones(len(looks), bool)
    keep[1:] = looks[1:] != looks[:-1]
    keep[words.starts] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return W.hashes(W.Words(looks[keep], before[words.starts], before[words.ends], words.first))


def features(words: W.Words, bits: int) -> np.ndarray:
    """Indices of the features of each word, one row for each kind."""
    h, shape = W.hashes(words), shapes(words)
    first = words.first[:-1][words.counts > 0]

    def pairs(x: np.ndarray) -> np.ndarray:
        before = np.concatenate([[START], x[:-1]])
        before[first] = START
        return W.mix(before * np.uint64(0x9E3779B97F4A7C15) + x)

    repeated = np.zeros(len(h), bool)
    repeated[1:] = h[1:] == h[:-1]
    repeated[first] = False
    kinds = [h, pairs(h), shape, pairs(shape), np.where(repeated, REPEAT, START)]
    return np.stack([(W.mix(x + np.uint64(i + 1)) >> np.uint64(64 - bits)).astype(np.int32) for i, x in enumerate(kinds)])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Model:
    """FTRL-proximal over (indices, values, label), several times in an order drawn anew from a fixed seed."""
    z, n = np.zeros((2, 1 << settings.bits))
    bias_z = bias_n = 0.0
    draw = np.random.default_rng(0)

    def weight(z, n):
        return np.where(np.abs(z) <= settings.l1, 0.0, -(z - np.sign(z) * settings.l1) / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2))

    def bias(z: float, n: float) -> float:
        return -z / ((settings.beta + n**0.5) / settings.alpha)

    for _ in range(settings.epochs):
        for k in draw.permutation(len(rows)):
            index, value, label = rows[k]
            w, b = weight(z[index], n[index]), bias(bias_z, bias_n)
            g = sigmoid(w @ value + b) - label
            grad = g * value
            z[index] += grad - (np.sqrt(n[index] + grad * grad) - np.sqrt(n[index])) / settings.alpha * w
            n[index] += grad * grad
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / settings.alpha * b
            bias_n += g * g
    return Model(weight(z, n), bias(bias_z, bias_n), settings.bits)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50.0, 50.0)))


def fit(docs: DataFrame, labels: DataFrame, label: str, id: str = "doc_id", text: str = "text", settings: Settings | None = None) -> Model:
    """Learn ``label`` (0 or 1) of ``labels`` from the whole texts of ``docs`` with the same ``id``.

    At most ``settings.max_rows`` labelled rows are used. Those are few enough to be broadcast, and their texts train in
    one task. Rows with a null id, label or text are left out; without any row the model scores 0.5 throughout. A row that
    is there twice counts twice.
    """
    settings = settings or Settings()
    chosen = labels.select(F.col(id).alias("__id"), F.col(label).cast("int").alias("label")).dropna()
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "label").limit(settings.max_rows)
    rows = docs.select(F.col(id).alias("__id"), F.col(text).alias("text")).dropna()
    # A text can stand under a chosen id more than once; the bound holds for rows, too.
    rows = rows.join(F.broadcast(chosen), "__id").orderBy(F.xxhash64("__id"), "__id", "label", F.xxhash64("text")).limit(settings.max_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            data, offsets = W.buffers(batch.column(0))
            for a, b in W.chunks(np.diff(offsets)):
                words = W.find(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.SPACES)
                every = features(words, settings.bits)
                for d in range(b - a):
                    mine = every[:, words.first[d] : words.first[d + 1]]
                    index, count = np.unique(mine, return_counts=True)
                    found.append((index, count * (SCALE / max(1, mine.shape[1])), int(batch.column(1)[a + d].as_py())))
        model = train(found, settings)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], ["weights", "bias"])

    row = rows.select("text", "label").coalesce(1).mapInArrow(learn, "weights binary, bias double").first()
    if row is None:
        return Model(np.zeros(1 << settings.bits), 0.0, settings.bits)
    return Model(np.frombuffer(row["weights"]).copy(), row["bias"], settings.bits)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", keep: bool = False, name: str = "score") -> DataFrame:
    """Return ``id`` and ``name`` (0 to 1, higher is likelier label 1) of each row's whole text; with ``keep`` all of ``docs``' columns too.

    Null and blank texts have no features and get the bias' score. Repeated rows stay; without ``keep`` other columns are
    ignored, with it a column called ``name`` is replaced. The model has ``2 ** bits`` weights, whatever the input's size,
    and is broadcast; a task holds about a MB of text's features at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32))
    bias, bits = model.bias, model.bits

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        data, offsets = W.buffers(texts)
        out = np.full(len(texts), bias)
        for a, b in W.chunks(np.diff(offsets)):
            words = W.find(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.SPACES)
            if len(words):
                sums = np.concatenate([[0.0], np.cumsum(shared.value[features(words, bits)].sum(0, dtype=np.float64))])
                out[a:b] += SCALE * (sums[words.first[1:]] - sums[words.first[:-1]]) / np.maximum(1, words.counts)
        return pa.array(sigmoid(out))

    value = once(scored)(quoted(text))
    return docs.withColumn(name, value) if keep else docs.select(quoted(id), value.alias(name))
