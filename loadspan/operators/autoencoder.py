"""Fixed-width features of sequences by a dense autoencoder in numpy.

Recurrent and convolutional encoders need a deep-learning library, which this package does without; their names are
accepted by the pipeline and give this encoder's features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = 64
MAX_TRAIN = 4096


def on_grid(x, size: int = GRID) -> np.ndarray:
    x = np.asarray(x, float)
    return np.interp(np.linspace(0, max(len(x) - 1, 0), size), np.arange(len(x)), x) if len(x) else np.zeros(size)


class Dense:
    """128-64-d-64-128 with rectified layers, trained by Adam on squared error; the same rows give the same weights."""

    def __init__(self, width: int, latent: int, seed: int = 0):
        rng, sizes = np.random.default_rng(seed), [width, 128, 64, latent, 64, 128, width]
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]

    def forward(self, x: np.ndarray, upto: int = 6) -> list[np.ndarray]:
        out = [x]
        for i in range(upto):
            z = out[-1] @ self.w[i] + self.b[i]
            out.append(z if i in (2, 5) else np.maximum(z, 0))
        return out

    def fit(self, x: np.ndarray, epochs: int = 50, batch: int = 32, rate: float = 1e-3, patience: int = 5, seed: int = 0) -> list[float]:
        """Losses by epoch; stops after patience epochs without a better one."""
        rng, m, v, t, losses = np.random.default_rng(seed), [0.0] * 12, [0.0] * 12, 0, []
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for a in range(0, len(x), batch):
                part = x[order[a : a + batch]]
                layers = self.forward(part)
                d, t, grads = 2 * (layers[-1] - part) / part.size, t + 1, []
                total += float(((layers[-1] - part) ** 2).mean()) * len(part)
                for i in range(5, -1, -1):
                    grads += [d.sum(0), layers[i].T @ d]
                    d = d @ self.w[i].T
                    if i and i - 1 not in (2, 5):
                        d = d * (layers[i] > 0)
                for k, (g, p) in enumerate(zip(grads[::-1], [p for pair in zip(self.w, self.b) for p in pair])):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            losses.append(total / len(x))
            if len(losses) > patience and min(losses[-patience:]) >= min(losses[:-patience]):
                break
        return losses


def dense_autoencoder(df: DataFrame, latent: int = 16, epochs: int = 50, batch: int = 32, rate: float = 1e-3, patience: int = 5) -> DataFrame:
    """id, features: the middle layer for samples array<double>, put on a grid and scaled by the table's ends.

    Trained on MAX_TRAIN rows at most, in the order of a hash of id."""
    ends = df.select(F.explode("samples").alias("v")).agg(F.min("v"), F.max("v")).first()
    lo, width = ends[0] or 0.0, (ends[1] or 0.0) - (ends[0] or 0.0) + 1e-7
    rows = df.orderBy(F.xxhash64("id")).limit(MAX_TRAIN).select("samples").collect()
    net = Dense(GRID, latent)
    if rows:
        net.fit(np.stack([(on_grid(r[0]) - lo) / width for r in rows]), epochs, batch, rate, patience)

    def run(parts):
        for part in parts:
            x = np.stack([(on_grid(s) - lo) / width for s in part["samples"]]) if len(part) else np.zeros((0, GRID))
            yield pd.DataFrame({"id": part["id"], "features": list(net.forward(x, 3)[-1])})

    return df.select("id", "samples").mapInPandas(run, "id long, features array<double>")
