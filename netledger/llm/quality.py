"""Quality classifier: ordinal cumulative-link regression over hashed text.

Grades 0 < 1 < ... < K-1 share one weight vector over hashed text features; K-1 ordered thresholds cut the latent score:
P(grade <= k) = sigmoid(threshold_k - weights . x). The expected grade and the tail probability P(grade >= g) of a text
are what a selection works with.

Features of a text are the relative frequencies of its hashed character trigrams (case kept) and a few shape values
(share of capitals, symbols and distinct words, word length, text length), each hashed as a binned value.

Defined cases: a null text is an empty one; empty texts have shape features only; repeated rows get the same score each;
rows without a grade are not used for fitting; without any rated row there is no model, and scoring raises ValueError in
`fit` (an explicit error) unless the caller handles `None` from `fit_or_none`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from netledger.llm.textops import Codes, Words, class_table, lower_table, mix, passes, segment_sum, sorted_sets

BITS = 16
#: Rated rows that a fit uses at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 6000
#: Trigram frequencies are multiplied by this, so that they and the 0/1 shape features have comparable size.
SCALE = 25.0


def trigram_buckets(batch: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all character trigrams inside each text, and their bounds."""
    codes = batch.codes.astype(np.uint64)
    counts = np.maximum(np.diff(batch.offsets) - 2, 0)
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    if len(codes) < 3:
        return np.zeros(0, np.int64), bounds
    gram = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F))
    gram ^= codes[2:] * np.uint64(0x165667B19E3779F9)
    gram *= np.uint64(0xD6E8FEB86659FD93)
    bucket = (gram >> np.uint64(64 - BITS)).astype(np.int64)
    at = np.arange(bounds[-1]) + np.repeat(batch.offsets[:-1] - bounds[:-1], counts)
    return bucket[at], bounds


def shape_buckets(batch: Codes) -> np.ndarray:
    """One bucket per text and shape value (rows: texts)."""
    sizes = np.maximum(np.diff(batch.offsets), 1)
    kind = class_table()[batch.codes]
    words = Words(batch)
    n_words = np.diff(words.bounds)
    _, distinct = sorted_sets(words.hash, words.bounds)
    share = lambda mask: segment_sum(mask.astype(np.float64), batch.offsets) / sizes
    values = np.stack([
        np.floor(share(lower_table()[batch.codes] != batch.codes) * 20),
        np.floor(share(kind == 0) * 40),
        np.floor(share(kind == 2) * 20),
        np.floor(np.diff(distinct) / np.maximum(n_words, 1) * 20),
        np.minimum(np.floor(share((kind == 1) | (kind == 2)) * sizes / np.maximum(n_words, 1)), 15),
        np.minimum(np.floor(np.log2(sizes)), 20),
    ], axis=1).astype(np.uint64)
    names = np.arange(1, values.shape[1] + 1, dtype=np.uint64) * np.uint64(1_000_003)
    return (mix(values + names[None, :]) >> np.uint64(64 - BITS)).astype(np.int64)


def sparse_features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text."""
    for _, group in passes(texts):
        batch = Codes(group)
        grams, bounds = trigram_buckets(batch)
        shape = shape_buckets(batch)
        for i in range(len(group)):
            own, counts = np.unique(grams[bounds[i]:bounds[i + 1]], return_counts=True)
            values = counts * (SCALE / max(counts.sum(), 1))
            yield np.concatenate([own, shape[i]]), np.concatenate([values, np.ones(shape.shape[1])])


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def latent(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, group in passes(texts):
            batch = Codes(group)
            grams, bounds = trigram_buckets(batch)
            mean = segment_sum(self.weights[grams], bounds) / np.maximum(np.diff(bounds), 1)
            out[first:first + len(group)] = mean * SCALE + self.weights[shape_buckets(batch)].sum(axis=1)
        return out

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1 (rows: texts)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - latent[:, None], -500, 500)))


def fit_rows(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, l2: float = 1e-4, steps: int = 250,
             rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty by adaptive gradient steps over (grade, buckets, values) rows."""
    y = np.array([r[0] for r in rows])
    lengths = np.array([len(r[1]) for r in rows])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    columns, place = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    values = np.concatenate([r[2] for r in rows])
    owner = np.repeat(np.arange(len(rows)), lengths)
    # Ordered thresholds: the first one free, each next one a positive step above.
    share = np.clip([(y <= k).mean() for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    steps_up = np.log(np.maximum(np.diff(start), 1e-2))
    theta = np.concatenate([np.zeros(len(columns)), start[:1], steps_up])
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for t in range(1, steps + 1):
        w, first, up = theta[: len(columns)], theta[len(columns)], np.exp(theta[len(columns) + 1:])
        cuts = first + np.concatenate([[0.0], np.cumsum(up)])
        latent = np.add.reduceat(w[place] * values, bounds[:-1])
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = sigmoid(edges[y + 1] - latent), sigmoid(edges[y] - latent)
        probability = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / probability, low * (1 - low) / probability
        d_latent = (d_high - d_low) / len(y)  # of the negative log likelihood
        grad = np.zeros_like(theta)
        grad[: len(columns)] = np.bincount(place, values * d_latent[owner], len(columns)) + l2 * w
        d_cut = np.array([(-(d_high * (y == k)) + d_low * (y == k + 1)).sum() for k in range(grades - 1)]) / len(y)
        grad[len(columns)] = d_cut.sum()
        for k in range(len(up)):
            grad[len(columns) + 1 + k] = d_cut[k + 1:].sum() * up[k]
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        theta = theta - rate * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float64)
    weights[columns] = theta[: len(columns)]
    return OrdinalModel(weights, theta[len(columns)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(columns) + 1:]))]))


def fit_or_none(docs: DataFrame, ratings: DataFrame, grades: int, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel | None:
    """Fit on at most sample_rows rated documents. docs: doc_id, text; ratings: doc_id, grade (0 .. grades-1).

    The sample is the ratings with the smallest hashes of their ids, so it does not depend on order or partitioning; it
    is broadcast (its size is bounded by sample_rows). Only its sparse features reach the driver.
    """
    chosen = (
        ratings.select("doc_id", F.col("grade").cast("int").alias("grade"))
        .filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(sparse_features(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([p[0].astype("<u2").tobytes() for p in pairs], pa.binary()),
                pa.array([p[1].astype("<f4").tobytes() for p in pairs], pa.binary()),
            ], ["grade", "buckets", "values"])

    rows = sample.mapInArrow(features, "grade int, buckets binary, values binary").toPandas()
    if rows.empty:
        return None
    parsed = [(int(g), np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64))
              for g, b, v in rows.sort_values(["grade", "buckets"]).itertuples(index=False)]
    return fit_rows(parsed, grades)


def fit(docs: DataFrame, ratings: DataFrame, grades: int, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    model = fit_or_none(docs, ratings, grades, sample_rows)
    if model is None:
        raise ValueError("no rated document to fit on")
    return model


def graded(model: OrdinalModel, text: Column, tail_from: int = 1) -> Column:
    """struct(expected_grade, tail_prob, grade): the mean grade, P(grade >= tail_from), and the most likely grade."""

    @F.pandas_udf("expected_grade double, tail_prob double, grade int")
    def score(texts: pd.Series) -> pd.DataFrame:
        tails = model.tails(model.latent(texts.tolist()))
        full = np.concatenate([np.ones((len(tails), 1)), tails, np.zeros((len(tails), 1))], axis=1)
        return pd.DataFrame({
            "expected_grade": tails.sum(axis=1), "tail_prob": full[:, tail_from],
            "grade": (full[:, :-1] - full[:, 1:]).argmax(axis=1).astype(np.int32),
        })

    return score(F.coalesce(text, F.lit("")))


def ratings_from_labels(labels: DataFrame) -> DataFrame:
    """Three grades from the two marks of `labels`: 0 poor, 1 well written but toxic, 2 well written and clean.

    Rows without a quality mark give no rating; a missing toxic mark counts as clean. Documents whose id has
    crc32(id as text) mod 5 = 0 are held out.
    """
    poor, toxic = F.col("quality") == 0, F.coalesce(F.col("toxic"), F.lit(0)) != 0
    return labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.when(poor, 0).when(toxic, 1).otherwise(2).alias("grade")
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
