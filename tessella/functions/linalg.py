"""Dense kernels on one institution's rows or on the anchors: numpy only, no Spark.

Eigenvectors are unique up to sign at best, so every result has its largest entry by magnitude made positive.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Transform = Callable[[np.ndarray], np.ndarray]


def sign_fixed(v: np.ndarray) -> np.ndarray:
    """Columns with their largest entry by magnitude positive."""
    if not v.size:
        return v
    lead = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]
    return v * np.where(lead < 0, -1.0, 1.0)


def smallest(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k least eigenpairs of a symmetric matrix."""
    w, v = np.linalg.eigh((a + a.T) / 2)
    return w[:k], sign_fixed(v[:, :k])


def generalised(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs with a v = w b v and v' b v = 1, by a Cholesky factor of b; ascending."""
    low = np.linalg.cholesky((b + b.T) / 2)
    half = np.linalg.solve(low, (a + a.T) / 2)
    w, u = np.linalg.eigh((c := np.linalg.solve(low, half.T)) / 2 + c.T / 2)
    return w, sign_fixed(np.linalg.solve(low.T, u))


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(d, 0))


def self_tuning(x: np.ndarray, k: int = 7, standardise: bool = True) -> float:
    """Median over rows of 1 / s / 3, s the distance to the k-th neighbour."""
    if standardise:
        s = x.std(axis=0)
        x = (x - x.mean(axis=0)) / np.where(s == 0, 1, s)
    d = (x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    kth = np.sqrt(np.maximum(np.sort(d, axis=1)[:, min(k, len(x) - 1) - 1], 0))
    return float(np.median(1 / np.maximum(kth, np.finfo(float).eps) / 3))


def padded(v: np.ndarray, k: int) -> np.ndarray:
    """k columns: cut, or filled with zeros."""
    return np.pad(v[:, :k], ((0, 0), (0, max(0, k - v.shape[1]))))


def pca(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the k leading right singular vectors of the centred rows; zero columns beyond the rank's bound."""
    mean = x.mean(axis=0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False)
    return mean, padded(sign_fixed(vt.T), k)


def centred_kernel(x: np.ndarray, gamma: float) -> tuple[np.ndarray, Transform]:
    """The RBF kernel of x with both means taken out, and the same for other rows against x, by the means of x."""
    gram = rbf(x, x, gamma)
    rows, whole = gram.mean(axis=0), gram.mean()

    def against(y: np.ndarray) -> np.ndarray:
        to = rbf(y, x, gamma)
        return to - to.mean(axis=1, keepdims=True) + (whole - rows)[None, :]  # in this order small kernel values are not rounded away

    return gram - rows[:, None] - rows[None, :] + whole, against


def inverse_root(a: np.ndarray) -> np.ndarray:
    """a^(-1/2) of a positive semidefinite matrix; directions without weight are left out."""
    w, v = np.linalg.eigh((a + a.T) / 2)
    good = w > max(w[-1], 0) * 1e-12
    return (v[:, good] / np.sqrt(w[good])) @ v[:, good].T


def kernel_pca(x: np.ndarray, k: int, gamma: float) -> Transform:
    """Scores of rows in the k leading components of the centred RBF kernel; components without variance are zero."""
    gram, against = centred_kernel(x, gamma)
    w, v = np.linalg.eigh(gram)
    w, v = w[::-1], sign_fixed(v[:, ::-1])
    good = w > max(w[0], 0) * 1e-12
    scale = padded(v * np.where(good, 1 / np.sqrt(np.where(good, w, 1)), 0), k)
    return lambda y: against(y) @ scale


def locality_projection(x: np.ndarray, k: int, neighbours: int, heat: float = 0.01, ridge: float = 1e-9) -> np.ndarray:
    """Directions that keep near rows near: least generalised eigenvectors of (x' L x, x' D x) of a heat-weighted neighbour graph.

    They are sought in the span of the rows. Directions orthogonal to all rows also give zero, but map every row to nothing; there are such with fewer rows than columns.
    What cannot be solved is an error, never other directions in their place.
    """
    d = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : max(1, min(neighbours, len(x) - 1))]
    w = np.zeros_like(d)
    rows = np.repeat(np.arange(len(x)), near.shape[1])
    w[rows, near.ravel()] = np.exp(-d[rows, near.ravel()] / heat)
    w = np.maximum(w, w.T)
    degree = np.diag(w.sum(axis=1))
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    span = sign_fixed(vt[s > s.max(initial=0) * 1e-10].T)
    z = x @ span
    # x' D x + ridge = r' r by the rows themselves: their squares can lose it where columns nearly depend on each other
    r = np.linalg.qr(np.vstack([np.sqrt(degree.diagonal())[:, None] * z, np.sqrt(ridge) * np.eye(z.shape[1])]), mode="r")
    unit = np.linalg.solve(r.T, z.T)
    _, v = smallest(unit @ (degree - w) @ unit.T, z.shape[1])
    v = np.linalg.solve(r, v)
    if not np.isfinite(v).all():
        raise np.linalg.LinAlgError("the rows' directions are not told apart")
    return padded(sign_fixed(span @ v), k)


def kernel_cca(x: np.ndarray, y: np.ndarray, k: int, gamma: float, ridge: float = 1e-4) -> Transform:
    """Directions of the RBF kernel of x that correlate with the linear kernel of y (one-hot labels)."""
    n = len(x)
    centre = np.eye(n) - 1 / n
    kx, ky = centre @ rbf(x, x, gamma) @ centre, centre @ (y @ y.T) @ centre
    w, v = generalised(kx @ ky @ kx, kx @ kx + ridge * np.eye(n))
    return lambda z, a=padded(v[:, ::-1], k): rbf(z, x, gamma) @ a


def median_width(x: np.ndarray) -> float:
    """1 / (2 median^2) of the distances between different rows; 0.5 where there are none."""
    d = (x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T
    apart = d[np.triu_indices(len(x), 1)]
    apart = apart[apart > 0]
    return float(1 / (2 * np.median(np.sqrt(apart)) ** 2)) if len(apart) else 0.5


def cca(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(correlations, directions of x) that correlate most with y; no more than y's rank, zero columns beyond."""
    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    return cca_of_moments(x.T @ x, x.T @ y, y.T @ y, k, ridge)


def cca_of_moments(xx: np.ndarray, cross: np.ndarray, yy: np.ndarray, k: int, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """The same from the centred sums of products."""
    w, v = generalised(cross @ np.linalg.solve(yy + ridge * np.eye(len(yy)), cross.T), xx + ridge * np.eye(len(xx)))
    spread = np.linalg.eigvalsh(yy)
    n = min(k, len(xx), int((spread > max(spread[-1], 0) * 1e-12).sum()))
    return np.sqrt(np.maximum(w[::-1][:n], 0)), padded(v[:, ::-1][:, :n], k)


def whitened_kernel_cca(x: np.ndarray, y: np.ndarray, k: int, gamma: float, ridge: float = 1e-3) -> tuple[np.ndarray, Transform]:
    """(singular values, scores) of the product of both centred kernels, whitened on each side: RBF of x, linear of y.

    In the eigenbases of the two kernels whitening is a diagonal, and y's basis has only as many columns as y.
    """
    gram, against = centred_kernel(x, gamma)
    e, u = np.linalg.eigh(gram)
    e = np.maximum(e, 0)
    v, s, _ = np.linalg.svd(y - y.mean(axis=0), full_matrices=False)
    left, values, _ = np.linalg.svd((e / np.sqrt(e + ridge))[:, None] * (u.T @ v) * (s**2 / np.sqrt(s**2 + ridge)), full_matrices=False)
    rank = int((s > s[:1] * 1e-12).sum())  # beyond it no direction tells anything of y
    a = padded(sign_fixed(u @ (left[:, :rank] / np.sqrt(e + ridge)[:, None])), k)
    return values[:k], lambda z: against(z) @ a


def symmetric_kernel_cca(x: np.ndarray, y: np.ndarray, k: int, gamma: float, ridge: float = 1e-3) -> Transform:
    """Scores along the leading eigenvectors of the symmetric part of (Kx + r)^-1 Ky (Ky + r)^-1 Kx."""
    kx, against = centred_kernel(x, gamma)
    y = y - y.mean(axis=0)
    ky, r = y @ y.T, ridge * np.eye(len(x))
    m = np.linalg.solve(kx + r, ky) @ np.linalg.solve(ky + r, kx)
    _, v = np.linalg.eigh((m + m.T) / 2)
    a = padded(sign_fixed(v[:, ::-1]), k)
    return lambda z: against(z) @ a


def random_orthogonal(n: int, rng: np.random.Generator) -> np.ndarray:
    q, r = np.linalg.qr(rng.normal(size=(n, n)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


# ---- alignment of the anchors' images

def left_singular(images: list[np.ndarray], p: int) -> np.ndarray:
    """Leading left singular vectors of the images side by side."""
    u, _, _ = np.linalg.svd(np.hstack(images), full_matrices=False)
    return padded(sign_fixed(u), p)


def shared_basis(images: list[np.ndarray], p: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(singular values, maps, target) from an orthonormal basis of each image.

    The singular vectors of [Q_1 ... Q_m] solve the generalised eigenproblem of the images without forming it: with m
    images its eigenvalues are 2 m - 2 s^2, and those of m I - sum of projections are m - s^2.
    """
    factors = [np.linalg.qr(s) for s in images]
    u, s, vt = np.linalg.svd(np.hstack([q for q, _ in factors]), full_matrices=False)
    flip = np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    u, v = u * flip, vt.T * flip
    maps, at = [], 0
    for q, r in factors:
        maps.append(padded(np.linalg.lstsq(r, v[at : at + q.shape[1]], rcond=None)[0], p))
        at += q.shape[1]
    return s[:p], maps, padded(u, p)


def block_eigen(images: list[np.ndarray], p: int, ridge: float = 1e-6, shift: float = 0.0, orthonormal: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """(eigenvalues, maps): least pairs of A = 2 m B - 2 W'W + shift I against B = blockdiag(S'S) + ridge I, or against I."""
    m, w = len(images), np.hstack(images)
    b = np.zeros((w.shape[1], w.shape[1]))
    cuts = np.cumsum([0, *(s.shape[1] for s in images)])
    for s, at in zip(images, cuts, strict=False):
        b[at : at + s.shape[1], at : at + s.shape[1]] = s.T @ s
    b += ridge * np.eye(len(b))
    a = 2 * m * b - 2 * w.T @ w + shift * np.eye(len(b))
    values, v = smallest(a, len(a)) if orthonormal else generalised(a, b)
    return values[:p], [padded(v[lo:hi], p) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def procrustes(image: np.ndarray, reference: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(image.T @ reference, full_matrices=False)
    return u @ vt


def smoother(image: np.ndarray, gamma: float, penalty: float, with_linear: bool = False, normalise: bool = True) -> tuple[np.ndarray, Callable[[np.ndarray], Transform]]:
    """(hat matrix, target -> map) of kernel ridge regression on the image, if asked with an unpenalised linear part.

    One radius scales every kernel of an institution, in fitting and in mapping.
    """
    gram = rbf(image, image, gamma)
    radius = np.linalg.eigvalsh(gram)[-1] if normalise else 1.0
    gram = gram / radius
    inverse = np.linalg.inv(gram + penalty * np.eye(len(gram)))
    if not with_linear:
        return gram @ inverse, lambda z: lambda x, b=inverse @ z: rbf(x, image, gamma) / radius @ b
    middle = np.linalg.pinv(image.T @ inverse @ image)
    onto = middle @ image.T @ inverse  # coefficients of the linear part
    hat = gram @ inverse + (image - gram @ inverse @ image) @ onto

    def fitted(z: np.ndarray) -> Transform:
        beta = onto @ z
        alpha = inverse @ (z - image @ beta)
        return lambda x: rbf(x, image, gamma) / radius @ alpha + x @ beta

    return hat, fitted


def least_disagreement(hats: list[np.ndarray], p: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, target): the p directions that all smoothers reproduce best."""
    total = sum((h - np.eye(len(h))).T @ (h - np.eye(len(h))) for h in hats)
    return smallest(total / max(np.trace(total), 1e-300), p)


def eigen_weights(values: np.ndarray) -> np.ndarray:
    """exp(-(w - w_1) / (w_p - w_1)): later directions count less."""
    spread = values[-1] - values[0]
    return np.exp(-(values - values[0]) / spread) if spread > 0 else np.ones_like(values)


def top_singular(a: np.ndarray, rounds: int = 60, tolerance: float = 1e-7, seed: int = 0) -> tuple[float, np.ndarray]:
    """Leading singular value and right vector by power iteration."""
    v = np.random.default_rng(seed).normal(size=a.shape[1])
    v /= np.linalg.norm(v)
    for _ in range(rounds):
        new = a.T @ (a @ v)
        size = np.linalg.norm(new)
        if size == 0:
            return 0.0, v
        new /= size
        if np.linalg.norm(new - v) < tolerance:
            v = new
            break
        v = new
    return float(np.linalg.norm(a @ v)), v


def linear_inversion(image: np.ndarray, anchors: np.ndarray, private: np.ndarray) -> np.ndarray:
    """Rows recovered from their private images by the linear map that the anchors give away."""
    return private @ np.linalg.pinv(np.linalg.pinv(anchors) @ image)


def alignment_errors(images: list[np.ndarray], p: int, penalty: float = 1e-3) -> tuple[float, float]:
    """What linear and kernel maps leave of their best p-dimensional target: the sums of squares over the images.

    The linear target is orthonormal, the kernel target has unit norm as a whole.
    """
    z = left_singular(images, p)
    linear = sum(((z - s @ (np.linalg.pinv(s) @ z)) ** 2).sum() for s in images)
    hats = [smoother(s, 1 / s.shape[1], penalty, normalise=False)[0] for s in images]
    _, z = least_disagreement(hats, p)
    z = z / np.linalg.norm(z)
    return float(linear), float(sum(((h @ z - z) ** 2).sum() for h in hats))
