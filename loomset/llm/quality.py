"""Ordinal quality classifier: a cumulative-link regression over hashed text.

Ratings are ordered grades. One weight vector over hashed features is shared by all grades, and
ordered thresholds cut the line that it projects texts on: P(grade >= k) = s(w.x - t_k). That
gives the expected grade and the probability of reaching any grade, on which documents are
selected.

Features are the shares of hashed byte trigrams, as they are and by character shape, and a few
figures of the whole text (repeated words and lines, length, shares of characters) in steps.

A null or empty text, and one of white space only, has no features: its expected grade and all
its probabilities are 0. Texts of any length are read whole. Repeated rows give repeated results.
An empty table gives an empty result. Without labelled texts of two grades nothing tells them apart:
every text with words then reaches the one grade that is known, or the highest if none is, with
probability 1 and any higher one with 0.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm.samples import labelled_sample
from loomset.llm.workers import add_columns, unused

BUCKETS = 1 << 14
SHAPES = 1 << 11
FIGURES = 128
SIZE = BUCKETS + SHAPES + FIGURES
STEPS = 250
LEARNING_RATE = 0.05
RIDGE = 2e-4

# Grades from 0 on, see ``grade``.
GRADES = 3

# Selection: the least probability of a grade above the lowest.
KEEP = 0.5


def _shape_table() -> np.ndarray:
    shape = np.arange(256, dtype=np.uint32)
    shape[0x61:0x7B] = 1
    shape[0x41:0x5B] = 2
    shape[0x30:0x3A] = 3
    shape[0x80:] = 4
    return shape


_SHAPE = _shape_table()


def _trigrams(codes: np.ndarray, buckets: int) -> np.ndarray:
    if len(codes) < 3:
        return np.empty(0, np.uint32)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA6B)
    mixed += codes[2:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    return mixed % np.uint32(buckets)


def _step(share: float) -> int:
    """A share in 8 steps, finer near 0."""
    return min(7, int(8 * share**0.5))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices of features and their values; none for a text without words."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    codes = np.frombuffer(raw, np.uint8)
    plain = np.bincount(_trigrams(codes.astype(np.uint32), BUCKETS), minlength=1)
    shaped = np.bincount(_trigrams(_SHAPE[codes], SHAPES), minlength=1)
    kinds = np.bincount(_SHAPE[codes], minlength=256) / len(codes)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    again = sum(map(bytes.__eq__, words[1:], words)) / len(words)
    figures = [
        _step(again),
        _step(len(set(words)) / len(words)),
        _step(len(set(lines)) / max(1, len(lines))),
        _step(float(kinds[2])),
        _step(float(kinds[3])),
        _step(float(kinds[5:].sum() - kinds[0x20] - kinds[0x0A])),
        min(7, len(words).bit_length() // 2),
        min(7, len(codes) // len(words) // 2),
    ]
    own = np.flatnonzero(plain), np.flatnonzero(shaped)
    marks = BUCKETS + SHAPES + 8 * np.arange(len(figures)) + np.array(figures)
    # Square roots of shares: a text's trigram values have length one whatever its size.
    values = [np.sqrt(c[i] / max(1, c.sum())) for c, i in zip((plain, shaped), own, strict=True)]
    return (
        np.concatenate([own[0], BUCKETS + own[1], marks]),
        np.concatenate([*values, np.ones(len(figures))]),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class OrdinalModel:
    """``weights`` shared by all grades and one threshold between each two neighbouring grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: Iterable[str]) -> np.ndarray:
        """P(grade >= k) for k from 1, a row for each text."""
        latent = []
        for text in texts:
            index, value = features(text)
            latent.append(float(self.weights[index] @ value) if len(index) else np.nan)
        line = np.array(latent)
        found = _sigmoid(line[:, None] - self.thresholds[None, :])
        found[:, np.isneginf(self.thresholds)] = 1
        found[:, np.isposinf(self.thresholds)] = 0
        found[np.isnan(line)] = 0
        return found


def fit_ordinal(texts: list[str], grades: list[int]) -> OrdinalModel:
    """Maximum likelihood with a ridge penalty, by Adam over all rows at a time.

    The first threshold and the logarithms of the gaps between thresholds are free, so the
    thresholds stay in order.
    """
    found = [features(t) for t in texts]
    usable = [i for i, (index, _) in enumerate(found) if len(index)]
    y = np.array([grades[i] for i in usable])
    top = int(y.max()) if len(y) else 0
    if not len(y) or y.min() == top:
        known = top if len(y) else GRADES - 1
        thresholds = np.where(np.arange(1, GRADES) <= known, -np.inf, np.inf)
        return OrdinalModel(np.zeros(SIZE), thresholds)
    sizes = np.array([len(found[i][0]) for i in usable])
    columns = np.concatenate([found[i][0] for i in usable])
    values = np.concatenate([found[i][1] for i in usable]).astype(np.float32)
    rows = np.repeat(np.arange(len(usable)), sizes)
    # Every grade weighs the same in sum up to a factor: rare ones count more.
    counts = np.bincount(y, minlength=top + 1)
    weight = (counts.sum() / np.maximum(counts, 1) ** 0.5)[y]
    weight = weight / weight.sum()

    reach = np.array([(y >= k).mean() for k in range(1, top + 1)]).clip(0.01, 0.99)
    start = np.maximum.accumulate(-np.log(reach / (1 - reach)) + 1e-3 * np.arange(top))
    state = np.concatenate([np.zeros(SIZE), start[:1], np.log(np.diff(start).clip(0.05))])
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        w, gaps = state[:SIZE], np.exp(state[SIZE + 1 :])
        thresholds = state[SIZE] + np.concatenate([[0], np.cumsum(gaps)])
        line = np.bincount(rows, w[columns] * values, minlength=len(y))
        reached = _sigmoid(line[:, None] - thresholds[None, :])
        full = np.concatenate([np.ones((len(y), 1)), reached, np.zeros((len(y), 1))], axis=1)
        each = np.arange(len(y))
        likely = np.maximum(full[each, y] - full[each, y + 1], 1e-9)
        slope = full * (1 - full)
        # Derivatives of the negative log likelihood by the line and by each threshold.
        d_line = -weight * (slope[each, y] - slope[each, y + 1]) / likely
        d_lower = np.where(y > 0, weight * slope[each, y] / likely, 0)
        d_upper = np.where(y < top, -weight * slope[each, y + 1] / likely, 0)
        d_threshold = np.bincount(np.maximum(y - 1, 0), d_lower, minlength=top)
        d_threshold += np.bincount(np.minimum(y, top - 1), d_upper, minlength=top)
        gradient = np.concatenate(
            [
                np.bincount(columns, d_line[rows] * values, minlength=SIZE) + RIDGE * w,
                [d_threshold.sum()],
                gaps * np.cumsum(d_threshold[::-1])[::-1][1:],
            ]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = LEARNING_RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        state -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    thresholds = state[SIZE] + np.concatenate([[0], np.cumsum(np.exp(state[SIZE + 1 :]))])
    return OrdinalModel(state[:SIZE], thresholds)


def grade(quality: Column, toxic: Column) -> Column:
    """Graded rating of a labelled document: 0 for poor text, 1 for good but toxic text, 2 for
    good text without fault."""
    return F.when(quality < 1, 0).when(toxic > 0, 1).otherwise(2)


def fit_quality(documents: DataFrame, labels: DataFrame, rows: int | None = None) -> OrdinalModel:
    """Fit on a bounded sample of labelled documents, see ``samples``."""
    graded = labels.withColumn("grade", grade(F.col("quality"), F.col("toxic"))).filter(
        F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    )
    more = {} if rows is None else {"rows": rows}
    sample = labelled_sample(documents, graded, "grade", **more)
    return fit_ordinal([row.text for row in sample], [row.grade for row in sample])


def score_quality(df: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``df`` with ``_expected_grade`` and ``_tails``, the probabilities of reaching each grade."""
    def work(texts: list[str]) -> list[pa.Array]:
        tails = model.tails(texts)
        return [pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))]

    return add_columns(df, text, "_expected_grade double, _tails array<double>", work)


def select_quality(df: DataFrame, model: OrdinalModel, least: float = KEEP) -> DataFrame:
    """The rows of ``df`` that likely reach a grade above the lowest."""
    chance = unused(df, "_chance")
    scored = add_columns(
        df, "text", f"{chance} double", lambda texts: [pa.array(model.tails(texts)[:, 0])]
    )
    return scored.filter(F.col(chance) >= least).drop(chance)
