"""A linear-chain conditional random field with two tags, in numpy, over many sequences at once."""

from __future__ import annotations

import numpy as np


def _order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences from long to short, and for each step the number that reach it."""
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max()) if len(lengths) else 0
    return order, np.searchsorted(-lengths[order], -np.arange(steps), "left")


def marginals(unary: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pair: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: (P(tag 1) of each token, forward and backward log odds).

    unary: each token's score for tag 1 over tag 0; pair[a, b]: score of tag b after tag a; first: score of starting
    with tag 1. Sequences are unary[starts[i]:starts[i] + lengths[i]]; none is empty.
    """
    forward, backward = np.empty(len(unary)), np.zeros(len(unary))
    order, alive = _order(lengths)
    begin, size = starts[order], lengths[order]
    (p00, p01), (p10, p11) = pair
    for t, n in enumerate(alive):
        at = begin[:n] + t
        if t == 0:
            forward[at] = unary[at] + first
        else:
            f = forward[at - 1]
            forward[at] = unary[at] + np.logaddexp(p01, f + p11) - np.logaddexp(p00, f + p10)
    for t in range(len(alive) - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        b = unary[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(p10, b + p11) - np.logaddexp(p00, b + p01)
    assert size.size == lengths.size
    return 1 / (1 + np.exp(-np.clip(forward + backward, -700, 700))), forward, backward


def pair_counts(unary, starts, lengths, pair, forward, backward) -> np.ndarray:
    """Expected numbers of each tag pair."""
    inner = np.ones(len(unary), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    f, b = forward[at - 1], unary[at] + backward[at]
    scores = np.stack([np.full(len(at), pair[0, 0]), pair[0, 1] + b, pair[1, 0] + f, pair[1, 1] + f + b])
    scores = np.exp(scores - scores.max(axis=0))
    return (scores / scores.sum(axis=0)).sum(axis=1).reshape(2, 2) if len(at) else np.zeros((2, 2))


class TokenField:
    """Word features' weights, tag-pair scores and the starting score, fitted by regularised maximum likelihood."""

    def __init__(self, n_features: int, l2: float = 0.02):
        self.weights, self.pair, self.first, self.l2 = np.zeros(n_features), np.zeros((2, 2)), 0.0, l2

    def unary(self, features: np.ndarray) -> np.ndarray:
        """features: (tokens, k) feature numbers, -1 for none."""
        return np.where(features >= 0, self.weights[features], 0.0).sum(axis=1)

    def fit(self, features: np.ndarray, tags: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rounds: int = 150, rate: float = 0.3) -> TokenField:
        """Adam on the whole sample; the same sample gives the same weights."""
        size = len(self.weights)
        inner = np.ones(len(tags), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        seen_pair = np.bincount(2 * tags[at - 1] + tags[at], minlength=4).reshape(2, 2).astype(float)
        has = features >= 0
        count = lambda x: np.bincount(features[has], np.broadcast_to(x[:, None], features.shape)[has], size)
        seen, seen_first = count(tags.astype(float)), tags[starts].sum()
        theta = np.zeros(size + 5)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for i in range(1, rounds + 1):
            self.weights, self.pair, self.first = theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4]
            unary = self.unary(features)
            p, f, b = marginals(unary, starts, lengths, self.pair, self.first)
            grad = np.concatenate([seen - count(p), (seen_pair - pair_counts(unary, starts, lengths, self.pair, f, b)).ravel(), [seen_first - p[starts].sum()]])
            grad -= self.l2 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8) / (1 + 0.02 * i)
        self.weights, self.pair, self.first = theta[:size], theta[size : size + 4].reshape(2, 2), float(theta[size + 4])
        return self
