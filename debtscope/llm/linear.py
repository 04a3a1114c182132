"""Sparse linear models over n-gram indicators scaled by naive Bayes log-count ratios.

A document is the sorted array of its distinct hashed features.  Everything here works on a
bounded training sample in the driver; scoring runs in the tasks with the folded weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class LinearModel:
    """Weight per feature (ratios folded in), bias, and the two calibration terms of the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


class Distinct:
    """Distinct features of one document at a time, in linear time and without clearing."""

    def __init__(self, size: int):
        self._stamp = np.zeros(size, np.int32)
        self._place = np.zeros(size, np.int32)
        self._now = 0

    def start(self) -> None:
        self._now += 1
        if self._now == np.iinfo(np.int32).max:
            self._stamp[:] = 0
            self._now = 1

    def new(self, features: np.ndarray) -> np.ndarray:
        """The features not met since :meth:`start`, each once."""
        features = features[self._stamp[features] != self._now]
        order = np.arange(len(features), dtype=np.int32)
        self._place[features] = order
        features = features[self._place[features] == order]
        self._stamp[features] = self._now
        return features


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of a feature's smoothed share among positive and among negative documents."""
    counts = []
    for label in (1, 0):
        chosen = [row for row, own in zip(rows, labels) if own == label]
        total = np.bincount(np.concatenate(chosen), minlength=size) if chosen else np.zeros(size)
        share = smooth + total
        counts.append(np.log(share / (len(chosen) + 2 * smooth)))
    return (counts[0] - counts[1]).astype(np.float32)


def length_scale(row: np.ndarray) -> float:
    """Documents are scaled to the root of their number of features, so that long texts do not dominate."""
    return 1.0 / np.sqrt(max(1, len(row)))


def hinge_dual(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7):
    """Linear hinge-loss model by dual coordinate descent: weights and bias.

    Each document has one dual variable in ``[0, cost]``; a step solves its one-variable problem
    and moves the weights along the document.  The bias is a constant feature.
    """
    rng = np.random.default_rng(seed)
    weights, bias = np.zeros(len(ratios)), 0.0
    values = [ratios[row] * length_scale(row) for row in rows]
    norms = np.array([float(v @ v) + 1.0 for v in values])
    signs, dual = np.where(labels == 1, 1.0, -1.0), np.zeros(len(rows))
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            gradient = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1.0
            moved = min(max(dual[i] - gradient / norms[i], 0.0), cost) - dual[i]
            if moved:
                dual[i] += moved
                weights[rows[i]] += moved * signs[i] * values[i]
                bias += moved * signs[i]
                most = max(most, abs(moved) * norms[i])
        if most < 1e-3:
            break
    return weights, bias


def margins(rows: list[np.ndarray], folded: np.ndarray, bias: float) -> np.ndarray:
    return np.array([folded[row].sum() * length_scale(row) + bias for row in rows])


def calibrate(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins of documents the model has not seen (Newton steps)."""
    slope, offset = 1.0, 0.0
    positive, negative = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(slope * margin + offset, -500, 500)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        change = np.linalg.solve(h, g)
        slope, offset = slope - change[0], offset - change[1]
        if np.abs(change).max() < 1e-9:
            break
    return float(max(slope, 1e-6)), float(offset)


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int, folds: int = 3) -> LinearModel:
    """Fit on all rows; calibrate on margins of rows that were left out in turn.

    Without rows, or with one label only, the model has no weights and answers the smoothed
    share of label 1.
    """
    labels = np.asarray(labels)
    positive = int((labels == 1).sum())
    if positive == 0 or positive == len(labels):
        share = (positive + 1) / (len(labels) + 2)
        return LinearModel(np.zeros(size, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))

    def folded(chosen: np.ndarray):
        some, own = [rows[i] for i in chosen], labels[chosen]
        ratios = log_count_ratios(some, own, size)
        weights, bias = hinge_dual(some, own, ratios)
        return (weights * ratios).astype(np.float32), bias

    turn, seen = np.arange(len(rows)) % folds, np.zeros(len(rows))
    for k in range(folds):
        inside, outside = np.flatnonzero(turn != k), np.flatnonzero(turn == k)
        if len(set(labels[inside])) == 2 and len(outside):
            seen[outside] = margins([rows[i] for i in outside], *folded(inside))
    slope, offset = calibrate(seen, labels)
    weights, bias = folded(np.arange(len(rows)))
    return LinearModel(weights, float(bias), slope, offset)
