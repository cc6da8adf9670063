"""NumPy kernels for one group's matrices; missing values are filled before they get here."""

from __future__ import annotations

import numpy as np


def ridge(x: np.ndarray, y: np.ndarray, lam: float | np.ndarray) -> np.ndarray:
    """Coefficients p x q without intercept; lam is one penalty, or one for each coefficient's row and target (p x q)."""
    gram, cross = x.T @ x, x.T @ y
    if np.ndim(lam) == 0:
        return np.linalg.solve(gram + lam * np.eye(len(gram)), cross)
    return np.stack([np.linalg.solve(gram + np.diag(lam[:, j]), cross[:, j]) for j in range(y.shape[1])], axis=1)


def ridge_grid(x: np.ndarray, y: np.ndarray, lams: tuple[float, ...]) -> np.ndarray:
    """ridge() for every penalty (one p x q matrix each), from one decomposition."""
    value, vector = np.linalg.eigh(x.T @ x)
    turned = vector.T @ (x.T @ y)
    return np.stack([vector @ (turned / (np.maximum(value, 0) + lam)[:, None]) for lam in lams])


def ols(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x, y, rcond=None)[0]


def lasso(x: np.ndarray, y: np.ndarray, lam: float, sweeps: int = 2000, tol: float = 1e-6) -> np.ndarray:
    """Coordinate descent on |y - x b|^2 / (2 n) + lam |b|_1, all targets side by side."""
    n = len(x)
    gram, cross = x.T @ x / n, x.T @ y / n
    scale = np.maximum(np.diag(gram), 1e-12)
    b = np.zeros((x.shape[1], y.shape[1]))
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(b)):
            z = cross[j] - gram[j] @ b + scale[j] * b[j]
            new = np.sign(z) * np.maximum(np.abs(z) - lam, 0) / scale[j]
            most = max(most, float(np.abs(new - b[j]).max(initial=0)))
            b[j] = new
        if most < tol:
            break
    return b


def nuclear(x: np.ndarray, y: np.ndarray, lam: float, mu: float, steps: int = 300, tol: float = 1e-6) -> np.ndarray:
    """Proximal gradient for ridge loss and a penalty mu on the sum of singular values."""
    gram, cross = x.T @ x + lam * np.eye(x.shape[1]), x.T @ y
    step = 1 / np.linalg.norm(gram, 2)
    w = np.zeros_like(cross)
    for _ in range(steps):
        u, s, vt = np.linalg.svd(w - step * (gram @ w - cross), full_matrices=False)
        new = (u * np.maximum(s - step * mu, 0)) @ vt
        done = np.linalg.norm(new - w) <= tol * max(1.0, np.linalg.norm(w))
        w = new
        if done:
            break
    return w


def low_rank(w: np.ndarray, k: int) -> np.ndarray:
    u, s, vt = np.linalg.svd(w, full_matrices=False)
    return (u[:, :k] * s[:k]) @ vt[:k]


def bulk_median(ratio: float, points: int = 20_001) -> float:
    """Median of the Marchenko-Pastur law of that aspect ratio (at most 1), by its density on a grid."""
    lo, hi = (1 - ratio**0.5) ** 2, (1 + ratio**0.5) ** 2
    # Angles put points close together at the edges, where the density's slope is steep.
    angle = np.linspace(0, np.pi, points)
    x = lo + (hi - lo) * (1 - np.cos(angle)) / 2
    density = np.sqrt(np.maximum((hi - x) * (x - lo), 0)) / (2 * np.pi * ratio * np.maximum(x, 1e-15)) * np.sin(angle)
    mass = np.append(0, np.cumsum((density[1:] + density[:-1]) / 2))
    return float(np.interp(0.5 * mass[-1], mass, x))


def hard_threshold(w: np.ndarray) -> tuple[np.ndarray, int]:
    """Singular values under the optimal hard threshold for unknown noise go; also how many stay.

    A matrix of zeros stays; where the median singular value is 0 there is no noise to measure, and nothing stays.
    """
    u, s, vt = np.linalg.svd(w, full_matrices=False)
    if not s.size or s[0] < 1e-14:
        return w.copy(), 0
    if np.median(s) < 1e-14:
        return np.zeros_like(w), 0
    b = min(w.shape) / max(w.shape)
    cut = np.sqrt(2 * (b + 1) + 8 * b / (b + 1 + np.sqrt(b * b + 14 * b + 1))) / np.sqrt(bulk_median(b)) * np.median(s)
    k = int((s >= cut).sum())
    return (u[:, :k] * s[:k]) @ vt[:k], k


def first_component(x: np.ndarray) -> np.ndarray:
    """Loadings of the leading principal component; the largest one is positive."""
    return leading(np.cov(x, rowvar=False).reshape(x.shape[1], x.shape[1]))


def leading(covariance: np.ndarray) -> np.ndarray:
    v = np.linalg.eigh(covariance)[1][:, -1]
    return v * np.sign(v[np.argmax(np.abs(v))])


def kmeans(x: np.ndarray, k: int, starts: int = 50, seed: int = 3) -> np.ndarray:
    """Labels of the best of several k-means++ starts, numbered by first appearance."""
    rng = np.random.default_rng(seed)
    best = (np.inf, np.zeros(len(x), int))
    for _ in range(starts):
        c = x[[int(rng.integers(len(x)))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
            c = np.vstack([c, x[int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else int(rng.integers(len(x)))]])
        for _ in range(100):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            lab = d.argmin(1)
            new = np.stack([x[lab == i].mean(0) if (lab == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        if (cost := float(d.min(1).sum())) < best[0] - 1e-12:
            best = (cost, lab)
    names = {v: i for i, v in enumerate(dict.fromkeys(best[1].tolist()))}
    return np.array([names[v] for v in best[1]])


def bipartite_vectors(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular vectors of the degree-scaled matrix of absolute weights, over the roots of degrees: rows' and columns', the first left out.

    A name without weight lies at 0, and vectors of no singular value count as 0: what rounding makes of them means nothing.
    """
    a = np.abs(np.nan_to_num(w))
    dr, dc = (np.where(d > 1e-12, 1 / np.sqrt(np.maximum(d, 1e-12)), 0.0) for d in (a.sum(1), a.sum(0)))
    u, s, vt = np.linalg.svd(dr[:, None] * a * dc[None], full_matrices=False)
    real = (s > 1e-9)[1:]
    return dr[:, None] * u[:, 1:] * real, dc[:, None] * vt[1:].T * real


def cocluster_of(vectors: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column labels from the bipartite_vectors(), which serve every k."""
    g = max(1, int(np.ceil(np.log2(k))))
    lab = kmeans(np.vstack([v[:, :g] for v in vectors]), k)
    return lab[: len(vectors[0])], lab[len(vectors[0]) :]


def cocluster(w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return cocluster_of(bipartite_vectors(w), k)


def discovered(p: np.ndarray, q: float) -> np.ndarray:
    """Benjamini-Hochberg at level q over one group's p values; those that are NaN take no part."""
    given = np.sort(p[np.isfinite(p)])
    under = np.flatnonzero(given <= q * np.arange(1, len(given) + 1) / max(1, len(given)))
    return p <= given[under[-1]] if len(under) else np.zeros(p.shape, bool)


def spectral(a: np.ndarray, k: int) -> np.ndarray:
    """Clusters from the leading eigenvectors of the symmetrised, degree-scaled affinity, rows of unit length."""
    s = (np.abs(a) + np.abs(a).T) / 2
    np.fill_diagonal(s, 0)
    d = 1 / np.sqrt(np.maximum(s.sum(1), 1e-12))
    v = np.linalg.eigh(d[:, None] * s * d[None])[1][:, -k:]
    return kmeans(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), k)


def top(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest, ties to the first."""
    return np.sort(np.argsort(-x, kind="stable")[:k])


def alternating(w: np.ndarray, targets: int, sources: int, rounds: int = 50, positive: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A dense block of |w|, or of w's positive part: targets that gain most from the sources, and back, until neither changes."""
    a = np.maximum(np.nan_to_num(w), 0) if positive else np.abs(np.nan_to_num(w))
    s = top(a.sum(0), sources)
    t = top(a[:, s].sum(1), targets)
    for _ in range(rounds):
        s2 = top(a[t].sum(0), sources)
        t2 = top(a[:, s2].sum(1), targets)
        if np.array_equal(s, s2) and np.array_equal(t, t2):
            break
        s, t = s2, t2
    return t, s


def sparse_rank_one(w: np.ndarray, rows: int, cols: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Truncated power iteration: non-negative unit vectors with so many entries, for a non-negative matrix."""

    def cut(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(x)
        i = top(np.maximum(x, 0), k)
        out[i] = np.maximum(x[i], 0)
        n = np.linalg.norm(out)
        return out / n if n > 0 else out

    v = cut(w.sum(0), cols)
    u = cut(w @ v, rows)
    for _ in range(rounds):
        v2 = cut(w.T @ u, cols)
        u2 = cut(w @ v2, rows)
        done = np.abs(u2 - u).max() + np.abs(v2 - v).max() < 1e-10
        u, v = u2, v2
        if done:
            break
    return u, v


def block_factor(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Target loadings and source weights of a signed block from its first singular pair, of absolute sum 1, sources net long."""
    u, s, vt = np.linalg.svd(np.nan_to_num(w), full_matrices=False)
    a, b = u[:, 0], vt[0]
    if not len(s) or s[0] <= 0:
        a, b = np.nan_to_num(w).sum(1), np.nan_to_num(w).sum(0)
    sign = 1 if b.sum() >= 0 else -1
    return sign * a / max(np.abs(a).sum(), 1e-12), sign * b / max(np.abs(b).sum(), 1e-12)


def leave_one_out_ridge(x: np.ndarray, y: np.ndarray, lams: tuple[float, ...]) -> tuple[float, np.ndarray]:
    """The penalty with the least leave-one-out error, from one decomposition, and its coefficients."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    uy = u.T @ y
    best = (np.inf, lams[0], np.zeros(x.shape[1]))
    for lam in lams:
        shrink = s**2 / (s**2 + lam)
        lever = ((u**2) * shrink).sum(1)
        err = ((y - u @ (shrink * uy)) / np.maximum(1 - lever, 1e-12)) ** 2
        if err.mean() < best[0] - 1e-15:
            best = (float(err.mean()), lam, vt.T @ (s / (s**2 + lam) * uy))
    return best[1], best[2]
