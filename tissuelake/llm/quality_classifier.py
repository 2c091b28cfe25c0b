"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are unigrams and bigrams of two word streams: the words themselves, lower-cased, and their shapes (letters by case, digits and other
characters, runs shortened; a word equal to the one before it has a shape of its own). A document's vector has the square roots of its n-grams'
shares in hashed places, so that its length does not matter, plus a constant. Scores are sparse dot products with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_slices, mix64

BUCKETS = 1 << 18
#: Expected number of labelled documents that a fit takes; all of them if there are fewer.
FIT_ROWS = 8192
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.1, 0.5, 3

_CLASS = np.full(256, ord("?"), dtype=np.uint8)
_CLASS[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("9")
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = _c
_RNG = np.random.default_rng(0xC1A55)
_SHAPE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_SAME = np.uint64(0x51CE5A3E51CE5A3E)


def _shapes(words: Words) -> np.ndarray:
    """Hashes of the words' shapes: the character classes in order, runs counted once."""
    if not len(words.starts):
        return words.hash
    classes = _CLASS[words.data]
    fresh = np.ones(len(classes), dtype=bool)
    fresh[1:] = classes[1:] != classes[:-1]
    fresh[words.starts] = True
    rank = np.cumsum(fresh)
    gaps = np.diff(np.append(words.starts, len(classes)))
    place = rank[words.starts[0] :] - np.repeat(rank[words.starts], gaps)
    inside = np.arange(words.starts[0], len(classes)) < np.repeat(words.ends, gaps)
    values = _SHAPE[classes[words.starts[0] :]] * (2 * place.astype(np.uint64) + np.uint64(1))
    values = np.where(fresh[words.starts[0] :] & inside, mix64(values), np.uint64(0))
    return mix64(np.add.reduceat(values, words.starts - words.starts[0]))


def features(words: Words, shapes: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of one document's vector. Place 0 is the constant."""
    if lo == hi:
        return np.zeros(1, np.int64), np.ones(1)
    w, s = words.hash[lo:hi], shapes[lo:hi].copy()
    s[1:][w[1:] == w[:-1]] = _SAME
    grams = [mix64(w + np.uint64(1)), mix64(w[:-1] * np.uint64(3) + w[1:]), mix64(s + np.uint64(2)), mix64(s[:-1] * np.uint64(5) + s[1:])]
    place, count = np.unique((np.concatenate(grams) % np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    return np.append(place + 1, 0), np.append(np.sqrt(count / (4 * len(w))), 1.0)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in byte_slices(batch["text"]):
            words = Words(data, offsets, lower=True)
            shapes = _shapes(words)
            rows = [features(words, shapes, lo, hi) for lo, hi in words]
            places, values = ([r[i].astype(kind).tolist() for r in rows] for i, kind in ((0, np.int32), (1, np.float64)))
            keys = [batch[c].slice(at, len(rows)) for c in ("doc_id", "label")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "label", "places", "values"])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> np.ndarray:
    """Weights after per-coordinate FTRL-proximal updates over the rows (places, values, label) in turn."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(passes):
        for places, values, label in rows:
            w = weights(z[places], n[places])
            gradient = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
            root = np.sqrt(n[places])
            n[places] += gradient**2
            z[places] += gradient - (np.sqrt(n[places]) - root) / ALPHA * w
    return weights(z, n)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bounded sample of one fit, in order of doc_id's hash. A partition without rows has no model."""
    rows = [(np.array(p), np.array(v), y) for batch in batches for p, v, y in zip(*(batch[c].to_pylist() for c in ("places", "values", "label")), strict=True)]
    if rows:
        w = ftrl(rows)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at])], ["place", "weight"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights from labels (doc_id, label 0 or 1) and the texts of docs; about fit_rows documents, chosen by a hash of doc_id.

    Null labels and ids are left out. Several labels of one document count as their rounded mean. Without labels all weights are 0.
    Only the sample's ids are sent to all tasks, only its vectors are gathered, and only the weights (BUCKETS at most) reach the driver.
    """
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    share = min(1.0, fit_rows / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("doc_id", F.round("label").cast("int").alias("label"))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    vectors = sample.mapInArrow(_vectors, "doc_id long, label int, places array<int>, values array<double>")
    ordered = vectors.repartition(1, F.lit(0)).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "places")
    model = ordered.mapInArrow(_train, "place int, weight double").toArrow()
    weights = np.zeros(BUCKETS)
    weights[model["place"].to_numpy()] = model["weight"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) for every row: the probability of label 1 by the whole text. Null and empty texts get that of the constant alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for at, data, offsets in byte_slices(batch["text"]):
                words = Words(data, offsets, lower=True)
                shapes = _shapes(words)
                sums = [w[p] @ v for p, v in (features(words, shapes, lo, hi) for lo, hi in words)]
                out = 1 / (1 + np.exp(-np.clip(np.array(sums), -35, 35)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(out)).cast(pa.int64()), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
