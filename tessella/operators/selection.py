"""Which eigenvectors make the shared space, when the anchors have labels: some by eigenvalue, the others by what they tell of the labels."""

from __future__ import annotations

import numpy as np

from .models import softmax_fit

#: Backward elimination starts from so many candidates for each direction asked for, those of least eigenvalue.
CANDIDATES = 3


def forward(vectors: np.ndarray, y: np.ndarray, p: int, fixed: int = 0) -> list[int]:
    """The first ``fixed`` columns, then one by one the column of greatest score statistic given a multinomial fit on those before.

    A column u scores, summed over classes c with residuals r_c and shares p_c of the fit: (u'r_c)^2 / u' diag(p_c (1 - p_c)) u.
    """
    classes = np.unique(y)
    onehot = (y[:, None] == classes).astype(float)
    numbers, chosen = np.searchsorted(classes, y), list(range(min(fixed, p, vectors.shape[1])))
    while len(chosen) < min(p, vectors.shape[1]):
        shares = np.broadcast_to(onehot.mean(axis=0), onehot.shape)
        if chosen:
            x = vectors[:, chosen] * np.sqrt(len(vectors))  # unit columns at the scale of standard scores
            w, b = softmax_fit(x, numbers, len(classes), rounds=150)
            z = x @ w + b
            shares = np.exp(z - z.max(axis=1, keepdims=True))
            shares /= shares.sum(axis=1, keepdims=True)
        score = ((vectors.T @ (onehot - shares)) ** 2 / np.maximum((vectors**2).T @ (shares * (1 - shares)), 1e-300)).sum(axis=1)
        score[chosen] = -1
        chosen.append(int(score.argmax()))
    return chosen


def backward(vectors: np.ndarray, y: np.ndarray, p: int, fixed: int = 0) -> list[int]:
    """The first ``fixed`` columns and those left of the first CANDIDATES p after dropping, one by one, the one whose loss raises the
    residual sum of squares least. Labels of classes are regressed as indicators."""
    fixed = min(fixed, p)
    left = list(range(fixed, min(CANDIDATES * p, vectors.shape[1])))
    target = (y[:, None] == np.unique(y)).astype(float) if y.dtype.kind in "iuSUO" else y[:, None]
    target = target - target.mean(axis=0)
    centred = vectors - vectors.mean(axis=0)

    def rss(columns: list[int]) -> float:
        x = centred[:, [*range(fixed), *columns]]
        return float(((target - x @ np.linalg.lstsq(x, target, rcond=None)[0]) ** 2).sum())

    while len(left) > p - fixed:
        left.remove(min(left, key=lambda c: (rss([x for x in left if x != c]), c)))
    return [*range(fixed), *left]


RULES = {"forward": forward, "backward": backward}


def choose(vectors: np.ndarray, y: np.ndarray, p: int, rule: str, ratio: float) -> list[int]:
    """p columns of ``vectors`` (ascending eigenvalues): a share 1 - ``ratio`` by eigenvalue, the rest by ``rule``."""
    if rule not in RULES:
        raise ValueError(f"unknown selection {rule!r}: one of {sorted(RULES)}")
    return RULES[rule](vectors, np.asarray(y), p, int(p * (1 - ratio)))
