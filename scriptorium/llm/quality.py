"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

A text is split into runs of letters and digits and runs of other characters
(its words).  Features are, hashed into ``2**bits`` places: each word lower-cased,
each pair of neighbours, and the shape of each word alone and with its
neighbour's (capitals, digits, other characters, length, equal to the word
before), so that texts of unseen words are judged as well.  Their values are the
counts over the number of features, times ``SCALE``.  A score is the sparse dot product with the
weights, through the logistic function; a text without words has the bias alone.

The model is fitted on at most ``max_rows`` labelled rows, the first ones by a
hash of their id (a documented bound: features of those rows go to one task,
which makes ``epochs`` passes over them).  Everything else, scoring above all,
covers all rows and whole texts.

Defined results: a null or empty text gets the bias's score; rows with a null
label or id are not learned from; repeated labels each count; without any
labelled row each score is 0.5; columns other than the id, the text and the
label are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import textcore as T
from scriptorium.llm.runtime import tuned, type_of
from scriptorium.session import spread

BITS = 18
MAX_ROWS = 8000
EPOCHS = 3
SCALE = 32.0
#: FTRL: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
#: A text is accepted from this score on.
ACCEPT = 0.7

_U = np.uint64
_SPACE = 0
_ALNUM = 1
_OTHER = 2
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[T.byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))] = _ALNUM
_KIND[~T.NON_SPACE] = _SPACE
_UPPER = T.byte_set((0x41, 0x5A))
_DIGIT = T.byte_set((0x30, 0x39))
_LETTERS = T.ALNUM | T.byte_set((0x41, 0x5A))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[T.Words, np.ndarray]:
    """Runs of letters and digits and runs of other characters, in order, with whether each is of the first kind."""
    alnum = T.split(data, offsets, _LETTERS, lower=True)
    other = T.split(data, offsets, T.NON_SPACE & ~_LETTERS, lower=False)
    start = np.concatenate([alnum.start, other.start])
    order = np.argsort(start, kind="stable")
    start = start[order]
    end = np.concatenate([alnum.end, other.end])[order]
    hashed = np.concatenate([alnum.hash, other.hash])[order]
    return T.Words(data, start, end, np.searchsorted(start, offsets), hashed), order < len(alnum.start)


def _shapes(words: T.Words, letters: np.ndarray) -> np.ndarray:
    """A small number for each word's look."""
    upper = np.concatenate([[0], np.cumsum(_UPPER[words.data])])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[words.data])])
    n = words.end - words.start
    n_upper = upper[words.end] - upper[words.start]
    first = _UPPER[words.data[words.start]] if len(n) else np.zeros(0, dtype=bool)
    capitals = np.where(n_upper == 0, 0, np.where((n_upper == n) & (n > 1), 3, np.where(first & (n_upper == 1), 1, 2)))
    digits = np.where(digit[words.end] > digit[words.start], 1, 0)
    length = np.minimum(np.log2(n + 1).astype(np.int64) if len(n) else n, 7)
    same = np.zeros(len(n), dtype=np.int64)
    same[1:] = words.hash[1:] == words.hash[:-1]
    same[words.first[:-1][words.counts > 0]] = 0  # what stands before a text is another one
    return (((letters * 4 + capitals) * 2 + digits) * 8 + length) * 2 + same


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of the texts, and each text's first feature."""
    words, letters = _words(data, offsets)
    n = len(words.start)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    shape = _shapes(words, letters).astype(_U)
    single = np.stack([words.hash, T.mix(shape + _U(1 << 20))], axis=1)
    pair = np.zeros((n, 2), dtype=_U)
    pair[:-1, 0] = T.mix(words.hash[:-1] * _U(3) + words.hash[1:])
    pair[:-1, 1] = T.mix(shape[:-1] * _U(4096) + shape[1:] + _U(1 << 40))
    last = words.first[1:][words.counts > 0] - 1
    every = np.concatenate([single, pair], axis=1)
    used = np.ones((n, 4), dtype=bool)
    used[last, 2:] = False
    place = (every >> _U(64 - bits)).astype(np.int64)[used]
    return place, np.concatenate([[0], np.cumsum(used.sum(axis=1))])[words.first]


@dataclass
class Model:
    bits: int
    bias: float
    weights: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sparse dot products of the texts' features with the weights, through the logistic function."""
        place, first = features(data, offsets, self.bits)
        n = np.diff(first)
        total = np.concatenate([[0.0], np.cumsum(self.weights[place])])
        dot = self.bias + SCALE * (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(dot, -60, 60)))


class Ftrl:
    """Follow-the-regularised-leader: a weight is closed form of its sums of gradients, zero below the first penalty."""

    def __init__(self, size: int):
        self.z = np.zeros(size)
        self.n = np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -60, 60)))
        g = (p - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def _train(bits: int, epochs: int):
    """Rows (label, places, counts) in order, to one row: bias and packed weights."""

    def run(batches):
        rows = []
        for batch in batches:
            rows += [(y, np.frombuffer(a, "<i4"), np.frombuffer(x, "<f4")) for y, a, x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        ftrl = Ftrl((1 << bits) + 1)
        bias = np.array([1 << bits])
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                y, at, x = rows[k]
                ftrl.learn(np.append(at, bias), np.append(x, 1.0), y)
        w = ftrl.weights(slice(None))
        yield pa.RecordBatch.from_arrays([pa.array([float(w[-1])]), pa.array([w[:-1].astype("<f4").tobytes()])], ["bias", "weights"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = BITS, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> Model:
    """The model from the first ``max_rows`` labelled rows by a hash of the id."""
    tuned(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")  # max_rows bounds what is broadcast

    def vectors(batches):
        for batch in batches:
            at, x = [], []
            for lo, hi, data, offsets in T.slices(batch.column(2)):
                place, first = features(data, offsets, bits)
                for k in range(hi - lo):
                    used, counts = np.unique(place[first[k] : first[k + 1]], return_counts=True)
                    at.append(used.astype("<i4").tobytes())
                    x.append((SCALE * counts / max(1, counts.sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["_id", "_y", "at", "x"])

    sparse = rows.select("_id", "_y", "_text").mapInArrow(vectors, f"_id {type_of(rows, '_id')}, _y double, at binary, x binary")
    one = sparse.repartition(1).sortWithinPartitions("_id", "_y", "at", "x").select("_y", "at", "x")
    found = one.mapInArrow(_train(bits, epochs), "bias double, weights binary").first()
    if found is None:  # no labelled row has a text
        return Model(bits, 0.0, np.zeros(1 << bits))
    bias, weights = found
    return Model(bits, bias, np.frombuffer(bytes(weights), "<f4").astype(np.float64))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): between 0 and 1, higher where label 1 is likelier."""
    spark = tuned(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # 2**bits weights

    def run(batches):
        model = sent.value
        for batch in batches:
            found = [model.scores(data, offsets) for _, _, data, offsets in T.slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], [id_col, "score"])

    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {type_of(docs, id_col)}, score double")


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, as they are."""
    spark = tuned(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        model = sent.value
        for batch in batches:
            found = [model.scores(data, offsets) for _, _, data, offsets in T.slices(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(found) >= least if found else np.zeros(0, dtype=bool)))

    return docs.mapInArrow(run, docs.schema)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels that are not held out."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(F.col("doc_id")) != 2)
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))
