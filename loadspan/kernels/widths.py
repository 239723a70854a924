"""Window sizes of a series."""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache
from itertools import count

import numpy as np

from loadspan.kernels.selfsim import windows


def suss(x: np.ndarray, least: int = 10, threshold: float = 0.89) -> int:
    """Twice the smallest width whose windows resemble the whole series (summary statistics subsequences).

    A width's likeness is the distance of its windows' mean, deviation and range from the series', over the root of the
    width, scaled so that width 1 has 0 and the widest has 1. Widths are bracketed by powers of two, then bisected.
    """
    n = len(x)
    if n < least:
        return n
    x = np.asarray(x, float) - x.min()
    if not x.max():
        return least
    x /= x.max()

    @lru_cache(maxsize=None)
    def distance(width: int) -> float:
        v = windows(x, width)[1:]
        gaps = (v.mean(1) - x.mean(), v.std(1) - x.std(), np.ptp(v, axis=1) - 1.0)
        return float(np.linalg.norm(gaps, axis=0).mean() / np.sqrt(width))

    far, near = distance(1), distance(n - 1)
    if far == near:
        return least
    alike = lambda width: width >= n - 1 or (far - distance(width)) / (far - near) >= threshold
    bracket = next(w for w in (1 << p for p in count()) if w >= least and alike(w))
    widths = range(max(least, bracket // 2), bracket + 2)
    return 2 * (widths.start + bisect_left(widths, True, key=alike))


def dominant_fourier_frequency(x: np.ndarray, least: int = 10, most: int = 1000) -> int:
    """The period of the strongest Fourier component from least to most; a series of under 2 * least points has its length."""
    n = len(x)
    if n < 2 * least:
        return n
    size = np.abs(np.fft.rfft(x))
    periods = n / np.maximum(np.arange(len(size)), 1e-9)
    ok = (np.arange(len(size)) > 0) & (periods >= least) & (periods < most)
    return int(periods[np.flatnonzero(ok)[np.argmax(size[ok])]]) if ok.any() else least


def highest_autocorrelation(x: np.ndarray, least: int = 10, most: int = 1000) -> int:
    """The lag, between least and most, of the highest peak of the autocorrelation."""
    n = len(x)
    if n < least:
        return n
    c = x - x.mean()
    full = np.fft.irfft(np.abs(np.fft.rfft(c, 2 * n)) ** 2)[:n]
    if full[0] <= 0:
        return least
    acf = full / full[0]
    lags = np.arange(1, n - 1)
    peaks = lags[(acf[1:-1] > acf[:-2]) & (acf[1:-1] >= acf[2:]) & (lags >= least) & (lags < most)]
    return int(peaks[np.argmax(acf[peaks])]) if len(peaks) else least


WIDTHS = {"suss": suss, "fft": dominant_fourier_frequency, "acf": highest_autocorrelation}
