"""Quality by nearest-neighbour voting in a latent semantic space.

A text is a histogram of its hashed byte triples, weighted by log frequency and inverse document frequency, and one
more term for how often a word follows itself, which no histogram of short pieces shows.  The singular vectors of a labelled sample turn it into a short unit vector; the sample's vectors are broadcast, every
document is compared with all of them in blocked matrix products, and its nearest neighbours' labels are averaged,
each weighted by its cosine.  The sample is the only thing that is bounded: every document is scored as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import release, share, slices, trim, utf8
from millrace.llm.words import words

TRIPLES = 2048
_REPEATS = np.array([0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.75])  # upper ends of the repetition terms
_REPEAT_WEIGHT = 0.7
FEATURES = TRIPLES + len(_REPEATS) + 1
_SPACE = 32
_ROWS = 256


def histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed byte triples (two spaces stand before each text) and a repetition term, one row per text."""
    rows, lengths = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((rows, FEATURES), np.int64)
    out[np.arange(rows), TRIPLES + np.searchsorted(_REPEATS, _repeated(data, offsets))] = lengths > 0
    if not len(data):
        return out
    starts = offsets[:-1][lengths > 0]
    last, second = np.empty_like(data), np.empty_like(data)
    last[1:], second[2:] = data[:-1], data[:-2]
    last[starts] = second[starts] = _SPACE
    follow = starts + 1
    second[follow[follow < len(data)]] = _SPACE
    code = (second.astype(np.uint32) << 16) | (last.astype(np.uint32) << 8) | data
    code *= np.uint32(2654435761)  # Knuth's multiplicative hash
    code >>= np.uint32(21)
    at = code.astype(np.int64) + np.repeat(np.arange(rows) * TRIPLES, lengths)
    out[:, :TRIPLES] = np.bincount(at, minlength=rows * TRIPLES).reshape(rows, TRIPLES)
    return out


def _repeated(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of each text's words that are the same as the word before."""
    found, bounds = words(data, offsets)
    same = np.zeros(len(found) + 1, np.int64)
    same[2:] = np.cumsum(found[1:] == found[:-1])
    first, last = np.minimum(bounds[:-1] + 1, len(found)), bounds[1:]
    pairs = np.maximum(last - first, 0)
    return np.where(pairs > 0, same[last] - same[np.minimum(first, last)], 0) / np.maximum(pairs, 1)


def _blocks(texts: pa.Array) -> Iterator[np.ndarray]:
    release()
    data, offsets = utf8(texts)
    for a, b in slices(offsets):
        for first in range(a, b, _ROWS):
            last = min(first + _ROWS, b)
            yield histograms(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    triples = _unit(np.log1p(counts[:, :TRIPLES].astype(np.float32)) * idf)
    return np.hstack([triples, counts[:, TRIPLES:].astype(np.float32) * np.float32(_REPEAT_WEIGHT)])


def _singular_vectors(rows: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """The leading right singular vectors by subspace iteration."""
    basis = np.random.default_rng(seed).standard_normal((rows.shape[1], min(rank + 16, *rows.shape))).astype(rows.dtype)
    for _ in range(6):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    left, _, right = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ right.T)[:, :rank]


@dataclass(frozen=True)
class QualityModel:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray  # of the labelled texts
    labels: np.ndarray
    neighbours: int

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weighted(counts, self.idf) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, weighted by cosine; the prior where none is similar."""
        out = np.full(len(counts), self.prior)
        near = min(self.neighbours, len(self.labels))
        if not near:
            return out
        cosines = self.project(counts) @ self.vectors.T
        if near < len(self.labels):
            at = np.argpartition(cosines, len(self.labels) - near, axis=1)[:, -near:]
        else:
            at = np.tile(np.arange(near), (len(counts), 1))
        weight = np.maximum(np.take_along_axis(cosines, at, axis=1), 0).astype(np.float64)
        total = weight.sum(axis=1)
        some = total > 0
        out[some] = (weight * self.labels[at]).sum(axis=1)[some] / total[some]
        return np.clip(out, 0, 1)


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str,
    text: str,
    label: str,
    max_labelled: int = 4096,
    rank: int = 64,
    neighbours: int = 15,
    seed: int = 23,
) -> QualityModel:
    """A model from about ``max_labelled`` labelled texts, chosen by a hash of their key.

    ``label`` is 0 or 1; NULL labels and keys teach nothing, NULL texts count as empty, and a key that is repeated on
    either side gives a vector per pair.  Without any labelled row every score is 0.5.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, F.col(label).alias("__label"))
    rate = min(1.0, max_labelled / max(1, usable.count()))
    chosen = usable.where(share(seed, key) < rate)
    shown = docs.select(key, F.col(text).alias("__text")).join(F.broadcast(chosen), key)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for b in _blocks(batch.column(2)) for r in b.astype("<u4")]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.binary())], ["y", "f"])

    rows = shown.select(key, F.col("__label").cast("int"), "__text").mapInArrow(features, "y int, f binary").toArrow()
    y = rows.column("y").to_numpy().astype(np.float64)
    if not len(y):
        one = np.ones(TRIPLES, np.float32)
        return QualityModel(one, np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), y, neighbours)
    counts = np.empty((len(y), FEATURES), "<u4")
    for i, f in enumerate(rows.column("f")):
        counts[i] = np.frombuffer(f.as_buffer(), "<u4")
    del rows
    order = np.lexsort((*counts[:, :8].T, counts.sum(axis=1), y))
    y, counts = y[order], counts[order]
    idf = np.log((1 + len(y)) / (1 + (counts[:, :TRIPLES] > 0).sum(axis=0))).astype(np.float32) + 1
    weighted = _weighted(counts, idf)
    del counts
    axes = _singular_vectors(weighted, min(rank, *weighted.shape), seed).astype(np.float32)
    vectors = _unit(weighted @ axes).astype(np.float32)
    del weighted
    trim()
    return QualityModel(idf, axes, vectors, y, neighbours)


def quality_score(docs: DataFrame, text: Column, model: QualityModel) -> Column:
    """Score from 0 to 1 of whole texts, higher where label 1 is likelier; NULL counts as empty, which has the prior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        parts = [shared.value.score(block) for block in _blocks(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return F.arrow_udf(score, "double")(text)
