"""A change-point detector that takes one value at a time and keeps a window of the last ones."""

from __future__ import annotations

import numpy as np

from loadspan.kernels.selfsim import DISTANCES, VALIDATIONS, profile, sliding_dot, smallest
from loadspan.kernels.widths import WIDTHS


class StreamingSegmentation:
    """update(x) returns the global index of a change point when one is found, else None.

    Holds the last n_timepoints values and, for each of their windows, its k nearest earlier-or-later windows so far: a
    new window looks through all held ones and takes the place of a worse neighbour in theirs, in time linear in the
    window. After n_warmup values (replayed) it looks for a split every jump values, from the last change point on.
    The state is plain numpy arrays and numbers, so it pickles small.
    """

    def __init__(self, n_timepoints=10_000, n_warmup=None, window_size="suss", k=3, distance="znormed_euclidean_distance", jump=5, validation="significance_test", threshold=None, excl_radius=5):
        if distance not in DISTANCES or distance == "shape_dtw":
            raise ValueError(f"{distance} can't be updated by value")
        self.n, self.k, self.distance, self.jump, self.validation = n_timepoints, k, distance, jump, validation
        self.warm = min(n_timepoints, n_warmup or n_timepoints)
        self.level = threshold if threshold is not None else {"significance_test": 1e-50, "score_threshold": 0.75}.get(validation, 0.0)
        self.width, self.radius = window_size, excl_radius
        self.w = window_size if isinstance(window_size, int) else 0
        self.x = np.zeros(0)
        self.best, self.near = np.zeros((0, k)), np.zeros((0, k), np.int64)
        self.seen, self.first, self.last_cp, self.buffer, self.found = 0, 0, 0, [], []

    def update(self, value: float) -> int | None:
        if self.buffer is not None:
            self.buffer.append(float(value))
            if len(self.buffer) < self.warm:
                return None
            if not self.w:
                self.w = max(3, WIDTHS[self.width](np.array(self.buffer)))
            values, self.buffer = self.buffer, None
            hits = [c for c in map(self._push, values) if c is not None]
            return hits[-1] if hits else None
        return self._push(float(value))

    def predict(self) -> int:
        """The last change point, counted from the first value of the stream."""
        if self.buffer is not None:
            raise RuntimeError("the detector is still warming up")
        return self.first + self.last_cp

    def _push(self, value: float) -> int | None:
        self.x = np.append(self.x, value)
        self.seen += 1
        if len(self.x) > self.n:
            self.x = self.x[1:]
            self.first += 1
            self.last_cp = max(0, self.last_cp - 1)
            if len(self.near):
                self.best, self.near = self.best[1:], self.near[1:]
        if len(self.x) < self.w:
            return None
        self._relate()
        least = self.w * self.radius
        if self.seen % self.jump or len(self.near) - self.last_cp < 2 * least:
            return None
        return self._look(least)

    def _relate(self) -> None:
        """Neighbours of the newest window; numbers of windows count from the start of the stream."""
        w, x = self.w, self.x
        count = len(x) - w + 1
        d = self._distances()
        d[max(0, count - 1 - w // 2) :] = np.inf
        now = self.first + count - 1
        at = smallest(d, self.k)
        at = at[np.isfinite(d[at])]
        best, near = np.full(self.k, np.inf), np.full(self.k, now, np.int64)
        best[: len(at)], near[: len(at)] = d[at], self.first + at
        worst = self.best[:, -1] if len(self.best) else np.zeros(0)
        rows = np.flatnonzero(d[: len(worst)] < worst)
        for i in rows.tolist():
            j = int(np.searchsorted(self.best[i], d[i], "right"))
            self.best[i, j + 1 :], self.near[i, j + 1 :] = self.best[i, j:-1].copy(), self.near[i, j:-1].copy()
            self.best[i, j], self.near[i, j] = d[i], now
        self.best, self.near = np.vstack([self.best, best]), np.vstack([self.near, near])

    def _distances(self) -> np.ndarray:
        from loadspan.kernels.selfsim import complexity, squares, window_stats

        w, x = self.w, self.x
        dot = sliding_dot(x[-w:], x)
        if self.distance == "znormed_euclidean_distance":
            mean, std = window_stats(x, w)
            return 2 * w * (1 - (dot - w * mean * mean[-1]) / (w * std * std[-1]))
        sq = squares(x, w)
        d = sq + sq[-1] - 2 * dot
        if self.distance == "cinvariant_euclidean_distance":
            ce = complexity(x, w)
            d = d * np.maximum(ce, ce[-1]) / np.minimum(ce, ce[-1])
        return d

    def _look(self, least: int) -> int | None:
        start = self.last_cp
        near = np.clip(self.near[start:] - self.first - start, -1, len(self.near) - start - 1)
        scores = profile(near, self.w, least, "f1")
        at = int(np.argmax(scores))
        if not np.isfinite(scores[at]) or at < least or len(near) - at < least:
            return None
        if not VALIDATIONS[self.validation](near, at, self.w, scores, self.level):
            return None
        self.last_cp = start + at
        self.found.append(self.first + self.last_cp)
        return self.found[-1]
