"""Dense linear algebra of moment matrices on the driver; sizes are those of features or states, never of frames."""

from __future__ import annotations

import numpy as np


def mdot(*matrices: np.ndarray) -> np.ndarray:
    return np.linalg.multi_dot(matrices) if len(matrices) > 1 else matrices[0]


def submatrix(m: np.ndarray, rows, cols=None) -> np.ndarray:
    return m[np.ix_(rows, rows if cols is None else cols)]


def sort_by_norm(values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-np.abs(values), kind="stable")
    return values[order], vectors[:, order]


def spd_eig(w: np.ndarray, epsilon: float = 1e-10, canonical_signs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of a symmetric positive matrix above ``epsilon`` (raised past the most negative eigenvalue), descending."""
    values, vectors = np.linalg.eigh((w + w.T) / 2)
    cut = max(epsilon, -values.min() + 1e-16 if values.min() < 0 else 0.0)
    values, vectors = sort_by_norm(values, vectors)
    keep = values > cut
    if not keep.any():
        raise ValueError("every eigenvalue is below epsilon")
    values, vectors = values[keep], vectors[:, keep]
    if canonical_signs:
        big = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
        vectors = vectors * np.where(big < 0, -1.0, 1.0)
    return values, vectors


def spd_inv(w: np.ndarray, epsilon: float = 1e-10) -> np.ndarray:
    s, v = spd_eig(w, epsilon)
    return (v / s) @ v.T


def spd_inv_sqrt(w: np.ndarray, epsilon: float = 1e-10) -> np.ndarray:
    s, v = spd_eig(w, epsilon)
    return (v / np.sqrt(s)) @ v.T


def spd_inv_split(w: np.ndarray, epsilon: float = 1e-10, canonical_signs: bool = False) -> np.ndarray:
    """``L`` with ``L L' = W^-1`` on the kept eigenspace."""
    s, v = spd_eig(w, epsilon, canonical_signs)
    return v / np.sqrt(s)


def eig_corr(c0: np.ndarray, ct: np.ndarray, epsilon: float = 1e-10, fix_signs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Solve ``Ct r = C0 r l`` after whitening; pairs by descending modulus, the largest element of each vector positive."""
    lead = spd_inv_split(c0, epsilon, True)
    inner = lead.T @ ct @ lead
    values, vectors = np.linalg.eigh((inner + inner.T) / 2) if np.allclose(inner, inner.T) else np.linalg.eig(inner)
    values, vectors = sort_by_norm(values, vectors)
    r = lead @ vectors
    if fix_signs:
        big = r[np.abs(r).argmax(0), np.arange(r.shape[1])]
        r = r * np.where(np.real(big) < 0, -1.0, 1.0)
    return values, r


def stationary(p: np.ndarray) -> np.ndarray:
    """The left fixed vector of a stochastic matrix, by solving with the normalisation as one equation."""
    n = len(p)
    a = np.vstack([p.T - np.eye(n), np.ones(n)])
    pi = np.linalg.lstsq(a, np.append(np.zeros(n), 1.0), rcond=None)[0]
    pi = np.maximum(pi, 0)
    for _ in range(3):  # polish
        pi = pi @ p
    return pi / pi.sum()


def logsumexp(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        out = np.log(np.sum(np.exp(np.sort(x - top, axis=axis if axis is not None else -1)), axis=axis, keepdims=True)) + top
    return out.squeeze(axis) if axis is not None else out.reshape(())[()]


def logsumexp_pair(a: float, b: float) -> float:
    top = max(a, b)
    return top if np.isinf(top) else top + float(np.log1p(np.exp(min(a, b) - top)))


def kahan_sum(values) -> float:
    """Compensated sum (Neumaier)."""
    total = rest = 0.0
    for v in values:
        t = total + v
        rest += (total - t) + v if abs(total) >= abs(v) else (v - t) + total
        total = t
    return total + rest


def logsumexp_kahan(values) -> float:
    """Log of the sum of exponentials with a compensated sum."""
    x = np.asarray(values, float).ravel()
    top = x.max() if len(x) else -np.inf
    return float(top) if not np.isfinite(top) else float(top + np.log(kahan_sum(np.exp(x - top).tolist())))


def logsumexp_sorted(values, kahan: bool = False) -> float:
    """Log of the sum of exponentials, added from the smallest up, on request with a compensated sum."""
    x = np.sort(np.asarray(values, float).ravel())
    if kahan or not len(x) or not np.isfinite(x[-1]):
        return logsumexp_kahan(x)
    return float(x[-1] + np.log(np.cumsum(np.exp(x - x[-1]))[-1]))


def connected_sets(c: np.ndarray, mincount: float = 0.0, strong: bool = True) -> list[np.ndarray]:
    """Components of the graph of counts above ``mincount``, largest first (ties: smallest state first)."""
    n = len(c)
    edge = (c > 0) & (c >= mincount)
    if not strong:
        edge = edge | edge.T
    nxt = [np.flatnonzero(row).tolist() for row in edge]
    index, low, on = [-1] * n, [0] * n, [False] * n
    stack: list[int] = []
    out: list[np.ndarray] = []
    count = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, 0)]
        while work:
            v, k = work.pop()
            if k == 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            else:
                low[v] = min(low[v], low[nxt[v][k - 1]])
            while k < len(nxt[v]) and index[nxt[v][k]] >= 0:
                if on[nxt[v][k]]:
                    low[v] = min(low[v], index[nxt[v][k]])
                k += 1
            if k < len(nxt[v]):
                work += [(v, k + 1), (nxt[v][k], 0)]
            elif low[v] == index[v]:
                part = []
                while True:
                    w = stack.pop()
                    on[w] = False
                    part.append(w)
                    if w == v:
                        break
                out.append(np.array(sorted(part)))
    return sorted(out, key=lambda s: (-len(s), s[0]))
