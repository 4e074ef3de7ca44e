"""Observable-operator reweighting: transition matrices freed from the bias of non-equilibrium starts.

Two-step counts are one window pass; one-step counts leave out each trajectory's last ``lag`` frames so that they match.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from kinelake.functions.linalg import connected_sets
from kinelake.functions.support import TimeUnit
from kinelake.operators import dtrajs as D
from kinelake.operators.msm import MSM


def bootstrap_singular_values(c: np.ndarray, n: int = 1000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the singular values of resampled count matrices."""
    rng = np.random.default_rng(seed)
    total = int(c.sum())
    s = np.array([np.linalg.svd(rng.multinomial(total, (c / c.sum()).ravel()).reshape(c.shape).astype(float), compute_uv=False) for _ in range(n)])
    return s.mean(0), s.std(0)


def rank_decision(mean: np.ndarray, dev: np.ndarray, tol: float = 10.0) -> np.ndarray:
    """Which singular values stand out from their statistical error."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(dev > 0, mean / dev, np.inf) >= tol


def oom_components(ct: np.ndarray, c2t: np.ndarray, rank: np.ndarray | None = None, tol_one: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Observable operators ``xi[r, state, r]``, stationary and evaluation vectors, and their eigenvalues."""
    u, s, vt = np.linalg.svd(ct)
    keep = np.flatnonzero(s > 1e-12 * s[0]) if rank is None else np.flatnonzero(rank & (s > 1e-12 * s[0]))
    f1, f2 = u[:, keep] / np.sqrt(s[keep]), vt[keep].T / np.sqrt(s[keep])
    xi = np.einsum("ia,imj,jb->amb", f1, c2t, f2)
    whole = xi.sum(1)
    values, right = np.linalg.eig(whole)
    k = int(np.argmin(np.abs(values - 1)))
    if abs(values[k] - 1) > tol_one:
        import warnings

        warnings.warn(f"the leading eigenvalue is {values[k]:.4g}, not 1", stacklevel=2)
    sigma = f1.T @ ct.sum(1)
    vl, left = np.linalg.eig(whole.T)
    omega = np.real(left[:, np.argmin(np.abs(vl - 1))])
    omega = omega / (omega @ sigma)
    return xi, omega, sigma, values[np.argsort(-np.abs(values))]


def equilibrium_transition_matrix(xi: np.ndarray, omega: np.ndarray, sigma: np.ndarray, reversible: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Equilibrium pair probabilities, negative ones to 0, restricted to their largest connected set."""
    pair = np.einsum("a,aib,bjc,c->ij", omega, xi, xi, sigma)
    pair = np.maximum(pair, 0)
    if reversible:
        pair = (pair + pair.T) / 2
    keep = connected_sets(pair, 0.0)[0]
    pair = pair[np.ix_(keep, keep)]
    return pair / pair.sum(1, keepdims=True), keep


@dataclass
class OOMEstimator:
    lag: int = 1
    reversible: bool = True
    tol_rank: float = 10.0
    nbs: int = 500
    dt: str = "1 step"
    mincount: float | str = "1/n"
    seed: int = 0
    model: MSM | None = None

    def fit(self, dtrajs: DataFrame) -> OOMEstimator:
        n = D.number_of_states(dtrajs)
        rows = D.two_step_counts(dtrajs, self.lag).collect()  # at most one row for each triple of states
        c2 = np.zeros((n, n, n))
        for r in rows:
            c2[r.i, r.mid, r.j] = r.n
        ct = c2.sum(2)  # pairs whose trajectory goes on for another lag
        least = 1.0 / n if self.mincount == "1/n" else float(self.mincount)
        self.active = active = connected_sets(ct, least)[0]
        c2, c = c2[np.ix_(active, active, active)], ct[np.ix_(active, active)]
        mean, dev = bootstrap_singular_values(c, self.nbs, self.seed)
        xi, omega, sigma, self.eigenvalues_oom = oom_components(c, c2, rank_decision(mean, dev, self.tol_rank))
        p, keep = equilibrium_transition_matrix(xi, omega, sigma, self.reversible)
        self.active = active[keep]
        self.model = MSM(p, None, self.reversible or None, TimeUnit.parse(self.dt).scaled(self.lag), self.active, n)
        return self

    @property
    def timescales_oom(self) -> np.ndarray:
        return -self.lag / np.log(np.abs(self.eigenvalues_oom[1:]))
