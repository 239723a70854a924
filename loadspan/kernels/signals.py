"""Median filter, wavelet split, matrix-profile regimes and likelihood-ratio primitives."""

from __future__ import annotations

import numpy as np

from loadspan.kernels.selfsim import DistanceRows

# The eight taps of Daubechies' wavelet of four vanishing moments (decomposition low-pass).
DB4 = np.array([
    -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
    -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
])
_HIGH = DB4[::-1] * np.array([-1, 1] * 4)


def median_filter5(x: np.ndarray) -> np.ndarray:
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(np.asarray(x, float), 2), 5), axis=1)


def _down(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    return np.convolve(np.pad(x, 7, mode="symmetric"), taps)[8 : 8 + len(x) + 7 - 1][:: 2][: (len(x) + 7) // 2]


def _up(c: np.ndarray, taps: np.ndarray, n: int) -> np.ndarray:
    wide = np.zeros(2 * len(c))
    wide[::2] = c
    return np.convolve(wide, taps)[6 : 6 + n]


def wavelet_split(x: np.ndarray, level: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) parts of x, adding up to it: the approximation after level halvings, and the details."""
    x = np.asarray(x, float)
    if len(x) < 8:
        return x.copy(), np.zeros(len(x))
    sizes, c = [], x
    for _ in range(level):
        sizes.append(len(c))
        c = _down(c, DB4)
    for n in reversed(sizes):
        c = _up(c, DB4[::-1], n + n % 2)[:n]
    return c, x - c


def synthesised(low: list[int], high: list[int]) -> list[float]:
    """Change points of two parts as one list: each of the shorter list joins the nearest of the longer (the first if
    equally near; low if equally long), and every group is its mean."""
    base, rest = (low, high) if len(low) >= len(high) else (high, low)
    groups = [[float(b)] for b in sorted(base)]
    ref = np.array(sorted(base), float)
    for p in rest:
        groups[int(np.argmin(np.abs(ref - p)))].append(float(p))
    return sorted(float(np.mean(g)) for g in groups)


def matrix_profile(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance to and index of the nearest other window, within a quarter width excluded."""
    n = len(x) - w + 1
    rows, zone = DistanceRows(np.asarray(x, float), w, "znormed_euclidean_distance"), int(np.ceil(w / 4))
    best, at = np.full(n, np.inf), np.zeros(n, np.int64)
    for i in range(n):
        d = np.sqrt(np.maximum(rows.row(i), 0.0))
        d[max(0, i - zone) : i + zone + 1] = np.inf
        at[i] = int(np.argmin(d))
        best[i] = d[at[i]]
    return best, at


def fluss(x: np.ndarray, w: int = 30, n_regimes: int = 2, excl_factor: int = 4) -> list[int]:
    """n_regimes - 1 boundaries at the lowest points of the corrected arc curve; [] for short or constant series."""
    x = np.asarray(x, float)
    if len(x) < max(2 * w, w + n_regimes) or np.allclose(x, x[0], atol=1e-9):
        return []
    best, at = matrix_profile(x, w)
    if not np.isfinite(best).any():
        return []
    n = len(at)
    while excl_factor > 1 and 2 * w * excl_factor >= n:
        excl_factor -= 1
    lo, hi = np.minimum(np.arange(n), at), np.maximum(np.arange(n), at)
    arcs = np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1))[:n]
    i = np.arange(n)
    ideal = np.maximum(2 * i * (n - i) / n, 1e-9)
    curve = np.minimum(arcs / ideal, 1.0)
    curve[: w * excl_factor] = curve[n - w * excl_factor :] = 1.0
    found = []
    for _ in range(n_regimes - 1):
        c = int(np.argmin(curve))
        if curve[c] >= 1.0:
            break
        found.append(c)
        curve[max(0, c - w * excl_factor) : c + w * excl_factor] = 1.0
    return sorted(found)


def paa(x: np.ndarray, bins: int) -> np.ndarray:
    """Means of bins equal parts; an empty part takes the element at its edge."""
    edges = np.linspace(0, len(x), bins + 1).astype(int)
    return np.array([x[a:b].mean() if b > a else x[min(a, len(x) - 1)] for a, b in zip(edges, edges[1:])])


def glr_features(x: np.ndarray, w: int) -> np.ndarray:
    """(n, 4): the value, its step, its distance from the rolling median, and the rolling sample deviation."""
    n, after = len(x), (w - 1) // 2
    med, std = np.empty(n), np.zeros(n)
    for i in range(n):
        part = x[max(0, i + after - w + 1) : i + after + 1]
        med[i] = np.median(part)
        std[i] = part.std(ddof=1) if len(part) > 1 else 0.0
    return np.stack([x, np.diff(x, prepend=x[:1]), x - med, std], axis=1)


def glr_curve(features: np.ndarray, w: int) -> np.ndarray:
    n, out = len(features), np.zeros(len(features))
    sums, sq = (np.concatenate([np.zeros((1, features.shape[1])), np.cumsum(y, axis=0)]) for y in (features, features**2))
    t = np.arange(w, n - w)
    if len(t):
        mean = lambda a, b: (sums[b] - sums[a]) / w
        var = lambda a, b: np.maximum((sq[b] - sq[a]) / w - mean(a, b) ** 2, 0.0)
        out[t] = ((mean(t - w, t) - mean(t, t + w)) ** 2 / (var(t - w, t) / w + var(t, t + w) / w + 1e-12)).sum(1)
    return out


def peaks(curve: np.ndarray, alpha: float = 0.8, gap: int = 25, reach: int = 2) -> list[int]:
    """Greedy picks over the alpha quantile of positive scores, at least gap apart, moved to the top within reach."""
    if not (curve > 0).any():
        return []
    level = np.quantile(curve[curve > 0], alpha)
    kept: list[int] = []
    for i in sorted(np.flatnonzero(curve > level).tolist(), key=lambda i: -curve[i]):
        if all(abs(i - j) >= gap for j in kept):
            kept.append(i)
    top = lambda i: max(0, i - reach) + int(np.argmax(curve[max(0, i - reach) : i + reach + 1]))
    return sorted({top(i) for i in kept})


def _two_levels(x: np.ndarray) -> tuple[float, float]:
    """Means of the lower and the upper values, from the quartiles on, until they stand or one side is empty."""
    levels = np.quantile(x, [0.25, 0.75])
    for _ in range(20):
        up = np.abs(x - levels[1]) < np.abs(x - levels[0])
        if up.all() or not up.any():
            break
        before, levels = levels, np.array([x[~up].mean(), x[up].mean()])
        if np.abs(levels - before).max() < 1e-9:
            break
    return float(levels[0]), float(levels[1])


def descriptor(x: np.ndarray) -> np.ndarray:
    """34 numbers of one segment: six statistics of its level, its shape in 16 parts, the share of time and of steps
    between its two levels and the levels themselves, and its shape in 8 parts."""
    lo, hi = _two_levels(x)
    on = np.abs(x - hi) < np.abs(x - lo)
    tenth, median, ninth = np.quantile(x, [0.1, 0.5, 0.9])
    switches = float((on[1:] != on[:-1]).mean()) if len(x) > 1 else 0.0
    return np.concatenate([[x.mean(), x.std(), median, ninth - tenth, x.min(), x.max()], paa(x, 16), [on.mean(), switches, hi, lo], paa(x, 8)])


def viterbi(z: np.ndarray, lengths: np.ndarray, start: np.ndarray, n_states: int, sigma: float = 0.35, bonus: float = 2.0) -> np.ndarray:
    """Best states of segments: squared distances scaled by variances, and log-normal lengths, of the starting labels'
    groups; a state without segments has those of all."""
    log_len = np.log(np.maximum(lengths, 1))
    score = np.empty((len(z), n_states))
    for c in range(n_states):
        own = start == c if (start == c).any() else np.ones(len(z), bool)
        mean, var = z[own].mean(0), z[own].var(0) + 1e-6
        score[:, c] = -0.5 * ((z - mean) ** 2 / var).sum(1) - 0.5 * ((log_len - log_len[own].mean()) / sigma) ** 2 - log_len
    dp, back = score[:1].copy(), []
    for m in range(1, len(z)):
        step = dp[-1][:, None] + bonus * np.eye(n_states)
        back.append(step.argmax(0))
        dp = np.vstack([dp, step.max(0) + score[m]])
    path = [int(dp[-1].argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def prim_glr(x: np.ndarray, alpha: float = 0.8, gap: int = 25) -> list[int]:
    """Likelihood-ratio boundaries where the refined primitive changes; [] for under 8 points."""
    from loadspan.kernels.clustering import lloyd_best

    x = np.asarray(x, float)
    if len(x) < 8:
        return []
    w = min(50, max(3, len(x) // 10))
    cuts = peaks(glr_curve(glr_features(x, w), w), alpha, gap)
    bounds = [0, *[c for c in cuts if 0 < c < len(x)], len(x)]
    parts = [(a, b) for a, b in zip(bounds, bounds[1:]) if b - a >= 2]
    if len(parts) < 2:
        return []
    phi = np.stack([descriptor(x[a:b]) for a, b in parts])
    std = phi.std(0)
    z = (phi - phi.mean(0)) / np.where(std == 0, 1.0, std)
    states = min(6, max(2, len(parts) // 2))
    label, _, _ = lloyd_best(z, min(states, len(parts)), n_init=10, seed=0)
    label = viterbi(z, np.array([b - a for a, b in parts]), label, int(label.max()) + 1)
    return [parts[i][0] for i in range(1, len(parts)) if label[i] != label[i - 1]]
