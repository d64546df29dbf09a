"""Softmax regression on sparse features, by gradients that tasks add up; only sums of a fixed size reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 40
#: Tasks of a round; the rows are a bounded number.
TASKS = 4
RATE = 0.5
DECAY = 1e-4


def probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def logits(weights: np.ndarray, rows: int, of: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    """weights: features x classes, the last feature being the constant. of: the row of each (index, value)."""
    out = np.repeat(weights[-1:], rows, axis=0)
    for k in range(weights.shape[1]):
        out[:, k] += np.bincount(of, weights[index, k] * value, rows)
    return out


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    index, value = batch.column("index"), batch.column("value")
    of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(index.offsets)))
    return of, np.asarray(index.flatten()).astype(np.int64), np.asarray(value.flatten(), float)


def fitted(rows: DataFrame, n_features: int, n_classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """rows: index array<int>, value array<double>, aim array<double> (the classes' probabilities). Adaptive full-batch steps."""
    weights, seen = np.zeros((n_features + 1, n_classes)), np.zeros((n_features + 1, n_classes))
    rows = rows.select("index", "value", "aim")
    for _ in range(rounds):
        now = weights.copy()

        def gradient(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(now), 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                of, index, value = unpacked(batch)
                aim = np.asarray(batch.column("aim").flatten(), float).reshape(batch.num_rows, -1)
                miss = probabilities(logits(now, batch.num_rows, of, index, value)) - aim
                for k in range(now.shape[1]):
                    total[:-1, k] += np.bincount(index, miss[of, k] * value, len(now) - 1)
                total[-1] += miss.sum(axis=0)
                n += batch.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["g", "n"])

        parts = rows.mapInArrow(gradient, "g binary, n long").collect()
        n = sum(p["n"] for p in parts)
        if not n:
            break
        g = sum(np.frombuffer(p["g"]).reshape(weights.shape) for p in parts) / n + DECAY * np.vstack([weights[:-1], np.zeros((1, n_classes))])
        seen += g * g
        weights -= RATE * g / (np.sqrt(seen) + 1e-9)
    return weights
