"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 to K - 1 share one linear score of hashed text features; P(grade <= k) = logistic(threshold_k - score)
with ascending thresholds. Documents are selected by the tail probability of a grade.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.arrow import grouped, lists, map_batches
from pagemill.llm.quality import measures
from pagemill.llm.words import LOWER, NOT_ALNUM, U, words

GRADES = ("toxic", "low", "good")
DENSE = 8


class Setup(NamedTuple):
    """``sample``: rated documents that are fitted, at most (the documented bound of the fit; chosen by a hash
    of the id, so without regard to content). ``held_out``: one of so many of them is kept for the accuracy.
    ``least``: tail probability of the best grade from which a document is kept."""

    bits: int = 18
    sample: int = 12_000
    held_out: int = 10
    rounds: int = 200
    rate: float = 0.05
    decay: float = 3e-4
    least: float = 0.35


def grade(quality, toxic):
    """0 for toxic texts, 1 for low quality, 2 for good ones; null if unrated."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def features(data: np.ndarray, offsets: np.ndarray, bits: int):
    """Distinct hashed words of each row (flat, and how many each row has), and a few measures of shape."""
    n = len(offsets) - 1
    w = words(LOWER[data], offsets, NOT_ALNUM)
    cell = np.unique(w.row << bits | (w.hash >> U(64 - bits)).astype(np.int64))
    sizes = np.bincount(cell >> bits, minlength=n)
    m = measures(data, offsets)
    chars, total = m["chars"], np.maximum(m["chars"].sum(1), 1)
    counts = np.maximum(m["n_words"], 1)
    distinct = sizes / np.maximum(np.bincount(w.row, minlength=n), 1)
    letters = np.maximum(chars[:, 0] + chars[:, 1] + chars[:, 8], 1)
    dense = np.stack(
        [
            np.minimum(10 * m["n_symbols"] / counts, 5),
            5 * chars[:, 1] / letters,
            5 * chars[:, 2] / total,
            2 * distinct,
            m["n_repeat_words"] / counts,
            np.log1p(m["n_words"]) / 4,
            5 * chars[:, 5] / total,
            np.minimum(m["word_chars"] / counts, 40) / 10,
        ],
        axis=1,
    )
    return (cell & (1 << bits) - 1), sizes, dense


class Fitted(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray
    dense_mean: np.ndarray
    dense_scale: np.ndarray
    accuracy: float
    setup: Setup


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _score(cells, sizes, dense, weights, n_hashed):
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(rows, weights[cells], len(sizes)) + dense @ weights[n_hashed:]


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1 .. K - 1."""
    return _sigmoid(score[:, None] - thresholds[None, :])


def fit_arrays(cells, sizes, dense, grades, setup: Setup):
    """Weights and thresholds by full-batch Adam; thresholds stay ordered as sums of exponentials."""
    n_hashed, k = 1 << setup.bits, len(GRADES)
    weights = np.zeros(n_hashed + dense.shape[1])
    steps = np.zeros(k - 1)
    share = np.array([(grades <= j).mean() for j in range(k - 1)]).clip(0.01, 0.99)
    steps[0] = np.log(share[0] / (1 - share[0]))
    steps[1:] = np.log(np.maximum(np.diff(np.log(share / (1 - share))), 0.1))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(steps), np.zeros_like(steps)]
    # each grade weighs the same in sum
    balance = np.array([len(grades) / k / max((grades == g).sum(), 1) for g in range(k)])[grades]
    upper, lower = np.minimum(grades, k - 2), np.maximum(grades - 1, 0)
    for t in range(1, setup.rounds + 1):
        gaps = np.exp(steps[1:])
        thresholds = np.concatenate([steps[:1], steps[0] + np.cumsum(gaps)])
        score = np.bincount(rows, weights[cells], len(sizes)) + dense @ weights[n_hashed:]
        a = np.where(grades < k - 1, _sigmoid(thresholds[upper] - score), 1.0)
        b = np.where(grades > 0, _sigmoid(thresholds[lower] - score), 0.0)
        p = np.maximum(a - b, 1e-12)
        da, db = np.where(grades < k - 1, a * (1 - a), 0) / p * balance, np.where(grades > 0, b * (1 - b), 0) / p * balance
        d_score = (da - db) / len(grades)
        grad = np.empty_like(weights)
        grad[:n_hashed] = np.bincount(cells, d_score[rows], n_hashed)
        grad[n_hashed:] = d_score @ dense
        grad += setup.decay * weights
        d_threshold = (np.bincount(lower, db, k - 1) - np.bincount(upper, da, k - 1)) / len(grades)
        tail = d_threshold[::-1].cumsum()[::-1]
        d_steps = np.concatenate([tail[:1], tail[1:] * gaps])
        for which, (value, g) in enumerate(((weights, grad), (steps, d_steps))):
            m, v = moments[2 * which], moments[2 * which + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= setup.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    thresholds = np.concatenate([steps[:1], steps[0] + np.cumsum(np.exp(steps[1:]))])
    return weights.astype(np.float32), thresholds


def fit(docs: DataFrame, labels: DataFrame, setup: Setup = Setup()) -> Fitted | None:
    """From a bounded sample of rated documents; None if there is none.

    Features are made in the tasks, and only those of the sample reach the driver. Of several ratings of a
    document the lowest grade counts; ratings of unknown or null ids don't.
    """
    rated = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade(F.col("quality"), F.col("toxic")).alias("grade"))
        .where("doc_id is not null and grade is not null")
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
    )
    picked = rated.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(setup.sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "grade", "text")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells, sizes, dense = [], [], []
        for _, _, data, offsets in grouped(batch.column(2)):
            c, s, d = features(data, offsets, setup.bits)
            cells.append(c.astype(np.int32))
            sizes.append(s)
            dense.append(d)
        dense = np.concatenate(dense)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                lists(np.concatenate(cells), np.concatenate(sizes), pa.int32()),
                lists(dense.ravel(), np.full(len(dense), DENSE), pa.float64()),
            ],
            ["doc_id", "grade", "cells", "dense"],
        )

    rows = map_batches(texts, make, "doc_id long, grade int, cells array<int>, dense array<double>").toArrow()
    rows = rows.combine_chunks().sort_by("doc_id") if rows.num_rows else rows
    if not rows.num_rows:
        return None
    grades = rows["grade"].to_numpy().astype(np.int64)
    column = rows["cells"].combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    cells = column.flatten().to_numpy().astype(np.int64)
    dense = rows["dense"].combine_chunks().flatten().to_numpy().reshape(-1, DENSE)
    mean, scale = dense.mean(0), np.maximum(dense.std(0), 1e-3)
    dense = (dense - mean) / scale
    out = np.arange(len(grades)) % setup.held_out == 0
    keep = np.repeat(~out, sizes)
    weights, thresholds = fit_arrays(cells[keep], sizes[~out], dense[~out], grades[~out], setup) if (~out).any() else (np.zeros((1 << setup.bits) + DENSE, np.float32), np.zeros(len(GRADES) - 1))
    held = tails(_score(cells[~keep], sizes[out], dense[out], weights, 1 << setup.bits), thresholds)
    accuracy = float((((held >= 0.5).sum(1)) == grades[out]).mean())
    return Fitted(weights, thresholds, mean, scale, accuracy, setup)


def classify(docs: DataFrame, fitted: Fitted | None, setup: Setup = Setup(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_not_toxic, p_good, kept) of each row of ``docs``.

    ``p_not_toxic`` and ``p_good`` are the tail probabilities of grades 1 and 2. A null or empty text is scored
    by its shape alone. Without a model all scores are null and every row is kept.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if fitted is None:
        nothing = [F.lit(None).cast("double").alias(c) for c in ("expected_grade", "p_not_toxic", "p_good")]
        return named.select("doc_id", *nothing, F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        f, parts = shared.value, []
        for _, _, data, offsets in grouped(batch.column(1)):
            cells, sizes, dense = features(data, offsets, f.setup.bits)
            score = _score(cells, sizes, (dense - f.dense_mean) / f.dense_scale, f.weights, 1 << f.setup.bits)
            parts.append(tails(score, f.thresholds))
        p = np.concatenate(parts)
        columns = [pa.array(x) for x in (p.sum(1), p[:, 0], p[:, 1], p[:, 1] >= setup.least)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "expected_grade", "p_not_toxic", "p_good", "kept"])

    return map_batches(named, run, "doc_id long, expected_grade double, p_not_toxic double, p_good double, kept boolean")


def quality_classifier(docs: DataFrame, labels: DataFrame, setup: Setup = Setup()) -> DataFrame:
    return classify(docs, fit(docs, labels, setup), setup)
