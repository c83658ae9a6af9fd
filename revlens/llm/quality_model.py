"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL.

Features of a text are its words, its pairs of words, its word shapes and its pairs of
shapes, hashed into one table of weights. A shape is a word with runs of lower-case
letters, capitals and digits cut to one sign each and punctuation kept, so that words
never seen before still say how a text is made. Training follows the regularised
leader, one document after the other; a score is the sparse dot product of a text's
features with the weights.

Training sees at most ``SAMPLE`` labelled documents, those with the smallest hash of
their id, so the model does not depend on the order of rows. That bound is the only
limit: every whole text is scored.

Defined results: a null or empty text has no features and gets the score of the bias;
repeated rows get the same score; labels that are null, and labelled ids without a
document, are left out; without any usable label the score is one half; equal hashes in
the draw of labelled documents go by their id; a long text is scored whole by one task,
with some tens of bytes for each of its bytes; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm import text_arrays as T

BITS = 18  # the table of weights has 2^18 entries, whatever the input
SAMPLE = 12_000  # labelled documents used for training
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 1.0
THRESHOLD = 0.3

_U = np.uint64
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a"):ord("z") + 1] = ord("a")
_CLASS[ord("A"):ord("Z") + 1] = ord("A")
_CLASS[ord("0"):ord("9") + 1] = ord("0")
_CLASS[0x80:] = ord("a")


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, table entry, value) of every feature occurrence of a chunk of texts."""
    start, end, doc = T.words(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    word = T.span_hash(T.prefix_hash(data), start, end)
    signs = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = (signs[1:] != signs[:-1]) | ~np.isin(signs[1:], (ord("a"), ord("A"), ord("0")))
    new[start] = True
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(new, out=kept[1:])
    shape = T.span_hash(T.prefix_hash(signs[new]), kept[start], kept[end])
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    same = (word[pair] == word[pair + 1]).astype(np.uint64)
    keys = [T.mixed(word ^ _U(0x51)),
            T.mixed(word[pair] * _U(3) + word[pair + 1] ^ _U(0x52)),
            T.mixed(shape ^ _U(0x53)),
            T.mixed(shape[pair] * _U(3) + shape[pair + 1] + same * _U(0xD1B54A32D192ED03) ^ _U(0x54))]
    counts = np.maximum(np.bincount(doc, minlength=len(offsets) - 1), 1)
    scale = [1 / np.sqrt(counts), 1 / np.sqrt(counts), 4.0 / counts, 4.0 / counts]
    docs = [doc, doc[pair], doc, doc[pair]]
    shift = _U(64 - bits)
    return (np.concatenate(docs), np.concatenate([(k >> shift).astype(np.int64) for k in keys]),
            np.concatenate([s[d] for s, d in zip(scale, docs)]))


class Ftrl:
    """Follow the regularised leader with per-coordinate rates and L1 and L2 terms; the last weight is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)

    def learn(self, entries: np.ndarray, values: np.ndarray, label: int) -> None:
        at, inverse = np.unique(np.append(entries, len(self.z) - 1), return_inverse=True)
        x = np.bincount(inverse, weights=np.append(values, 1.0))
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _trainer(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        model = Ftrl(bits)
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for first, _, data, offsets in T.chunks(batch.column("text")):
                doc, entry, value = features(data, offsets, bits)
                order = np.argsort(doc, kind="stable")
                borders = np.searchsorted(doc[order], np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    own = order[borders[i]:borders[i + 1]]
                    model.learn(entry[own], value[own], labels[first + i])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], ["weights"])
    return run


def held_out() -> Column:
    """Rows never used for training: one in five by the checksum of the id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """The weights, learnt from labelled documents (doc_id, quality) that are not held out.

    One task trains on the bounded sample in the order of the ids' hashes; what reaches
    the driver is one table of 2^bits + 1 four-byte weights.
    """
    by = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label")]
    chosen = (labels.select("doc_id", F.col("quality").cast("int").alias("label"))
              .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~F.coalesce(held_out(), F.lit(True)))
              .orderBy(*by).limit(sample))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").orderBy(*by, "text").limit(sample)
    found = rows.select("text", "label").coalesce(1).mapInArrow(_trainer(bits), "weights binary").collect()
    return np.frombuffer(found[0].weights, "<f4") if found else np.zeros((1 << bits) + 1, "<f4")


def _scorer(weights: np.ndarray, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        bias = float(weights[-1])
        for batch in batches:
            score = np.empty(batch.num_rows)
            for first, end, data, offsets in T.chunks(batch.columns[-1]):
                doc, entry, value = features(data, offsets, bits)
                total = np.bincount(doc, weights=weights[entry] * value, minlength=end - first)
                score[first:end] = 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], [f"c{i}" for i in range(len(kept))] + ["score"])
    return run


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], name: str = "score", bits: int = BITS) -> DataFrame:
    """The columns ``keep`` of every document and its score. ``weights`` has a fixed size, so it travels with the code."""
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, F.col("text").alias("scored"))
    scored = rows.mapInArrow(_scorer(weights, bits), docs.select(*kept, F.lit(0.0).alias("score")).schema)
    return scored.toDF(*keep, name)
