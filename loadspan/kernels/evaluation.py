"""Change-point metrics: covering, F measure, relative distance, matches within a tolerance."""

from __future__ import annotations

import numpy as np


def pieces(cps, n: int) -> list[tuple[int, int]]:
    cuts = [0, *sorted({int(c) for c in cps if 0 < c < n}), n]
    return list(zip(cuts, cuts[1:]))


def _jaccard(a: tuple[int, int], b: tuple[int, int]) -> float:
    both = max(0, min(a[1], b[1]) - max(a[0], b[0]))
    return both / (a[1] - a[0] + b[1] - b[0] - both)


def cover_single(truth, found, n: int) -> float:
    """Pieces of the truth, weighted by length, each with its best overlap among the found pieces."""
    return sum((a[1] - a[0]) * max(_jaccard(a, b) for b in pieces(found, n)) for a in pieces(truth, n)) / n


def covering(annotations: dict, found, n: int) -> float:
    return float(np.mean([cover_single(t, found, n) for t in annotations.values()]))


def hits(truth, found, margin: int = 5) -> set[int]:
    """True points that a found point, each used once, lies within margin of."""
    free, got = set(found), set()
    for t in sorted(truth):
        near = [f for f in free if abs(f - t) <= margin]
        if near:
            free.discard(min(near, key=lambda f: (abs(f - t), f)))
            got.add(t)
    return got


def f_measure(annotations: dict, found, margin: int = 5, alpha: float = 0.5) -> float:
    """F of precision against all annotators together and mean recall; 0 is a point of all."""
    found = {0, *found}
    sets = {k: {0, *v} for k, v in annotations.items()}
    precision = len(hits(set().union(*sets.values()), found, margin)) / len(found)
    recall = float(np.mean([len(hits(v, found, margin)) / len(v) for v in sets.values()]))
    return precision * recall / (alpha * recall + (1 - alpha) * precision)


def relative_distance(truth, found, n: int) -> float:
    """Mean distance of found points to the nearest true one, over n; nan without either."""
    if not len(truth) or not len(found):
        return float("nan")
    return float(np.abs(np.subtract.outer(np.asarray(found, float), np.asarray(truth, float))).min(1).mean() / n)


def matched(truth, found, tolerance: int) -> int:
    """Found points whose nearest true point is within tolerance and not taken by an earlier one."""
    used, truth = set(), np.asarray(sorted(truth), float)
    for f in found:
        if len(truth) and (i := int(np.argmin(np.abs(truth - f)))) not in used and abs(truth[i] - f) <= tolerance:
            used.add(i)
    return len(used)


def comparison(truth, found, n: int, shares=(0.005, 0.01, 0.02, 0.05)) -> dict:
    """f1 at each share of the length, over- and under-segmentation rates, and the median nearest distance in points."""
    out = {}
    for s in shares:
        m = matched(truth, found, max(2, round(s * n)))
        out[f"f1@{s:g}"] = 2 * m / (len(truth) + len(found)) if len(truth) + len(found) else 1.0
    out["osr"] = max(0, len(found) - len(truth)) / max(1, len(truth))
    out["usr"] = max(0, len(truth) - len(found)) / max(1, len(truth))
    near = np.abs(np.subtract.outer(np.asarray(found, float), np.asarray(truth, float))).min(1) if len(truth) and len(found) else np.array([])
    out["d_nn"] = float(np.median(near)) if near.size else None
    return out
