"""Markov state models: estimation from counted transitions, spectra, kinetics, coarse-graining and validation.

Counting is a Spark job; a count matrix has one row for each state and is solved on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from kinelake.functions.linalg import connected_sets, spd_inv_sqrt, stationary
from kinelake.functions.support import TimeUnit, confidence_interval, generate_lags, vamp_score
from kinelake.operators import dtrajs as D
from kinelake.operators.base import Estimator, Sampled

# Estimation of transition matrices


def mle_reversible(c: np.ndarray, maxiter: int = 1_000_000, maxerr: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The reversible maximum-likelihood matrix and its stationary vector, by the fixed point of ``x_ij``.

    ``x_ij = (c_ij + c_ji) / (c_i / x_i + c_j / x_j)``; rows of ``x`` normalised give the matrix.
    """
    both = c + c.T
    ci = c.sum(1)
    x = both.sum(1) / both.sum()
    for _ in range(maxiter):
        q = ci / np.maximum(x, 1e-300)
        with np.errstate(divide="ignore", invalid="ignore"):
            flow = np.where(both > 0, both / (q[:, None] + q), 0)
        new = flow.sum(1)
        new /= new.sum()
        err = np.abs(new - x).max()
        x = new
        if err < maxerr:
            break
    q = ci / np.maximum(x, 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        flow = np.where(both > 0, both / (q[:, None] + q), 0)
    return flow / flow.sum(1, keepdims=True), flow.sum(1) / flow.sum()


def mle_fixed_pi(c: np.ndarray, pi: np.ndarray, maxiter: int = 1_000_000, maxerr: float = 1e-12) -> np.ndarray:
    """The reversible maximum-likelihood matrix with a given stationary vector, by its Lagrange multipliers."""
    c = c.astype(float)
    pi = pi / pi.sum()
    both = c + c.T
    lam = np.maximum(both.sum(1) / 2, 1e-12)
    for _ in range(maxiter):
        with np.errstate(divide="ignore", invalid="ignore"):
            d = lam[:, None] * pi[None, :] + lam[None, :] * pi[:, None]
            new = np.where(both > 0, both * lam[:, None] * pi[None, :] / d, 0).sum(1)
        err = np.abs(new - lam).max() / max(1.0, np.abs(lam).max())
        lam = np.maximum(new, 1e-300)
        if err < maxerr:
            break
    d = lam[:, None] * pi[None, :] + lam[None, :] * pi[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(both > 0, both * pi[None, :] / d, 0)
    np.fill_diagonal(p, 0)
    top = p.sum(1).max()
    if top > 1:  # not yet converged: keep rows stochastic and pi stationary
        p /= top
    np.fill_diagonal(p, 1 - p.sum(1))
    return p


def transition_matrix(c: np.ndarray, reversible: bool = True, pi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if pi is not None:
        return mle_fixed_pi(c, pi), pi / pi.sum()
    if reversible:
        return mle_reversible(c)
    p = c / c.sum(1, keepdims=True)
    return p, stationary(p)


def sample_nonreversible(c: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A posterior sample: each row from its Dirichlet distribution over the transitions seen."""
    p = np.zeros_like(c, dtype=float)
    for i, row in enumerate(c):
        seen = row > 0
        p[i, seen] = rng.dirichlet(row[seen])
    return p


def sample_reversible(c: np.ndarray, x: np.ndarray, rng: np.random.Generator, steps: int = 1, pi: np.ndarray | None = None) -> np.ndarray:
    """Metropolis sweeps over the symmetric flows ``x``: log-normal proposals for every element seen; returns new flows."""
    both = np.triu((c + c.T) > 0)
    places = np.argwhere(both)
    x = x.copy()
    rows = x.sum(1)
    ci = c.sum(1)
    for _ in range(steps):
        for i, j in places[rng.permutation(len(places))]:
            if pi is not None and i == j:
                continue
            old = x[i, j]
            new = old * np.exp(rng.normal(0, 1.0))
            dx = new - old
            cij = c[i, j] + c[j, i] if i != j else c[i, i]
            if pi is None:
                ri, rj = rows[i] + dx, (rows[j] + dx if i != j else rows[i] + dx)
                log_a = cij * np.log(new / old) - ci[i] * np.log(ri / rows[i]) - (ci[j] * np.log(rj / rows[j]) if i != j else 0)
                if np.log(rng.random()) < log_a:
                    x[i, j] = x[j, i] = new
                    rows[i] = ri
                    rows[j] = rj
            else:  # row sums are fixed: what is added off the diagonal leaves it
                di, dj = x[i, i] - dx, x[j, j] - dx
                if di <= 0 or dj <= 0:
                    continue
                log_a = cij * np.log(new / old) + c[i, i] * np.log(di / x[i, i]) + c[j, j] * np.log(dj / x[j, j])
                if np.log(rng.random()) < log_a:
                    x[i, j] = x[j, i] = new
                    x[i, i], x[j, j] = di, dj
    return x


# Models


class MSM:
    """A transition matrix with its spectrum, kinetics and observables; times are in ``dt``."""

    def __init__(self, p: np.ndarray, pi: np.ndarray | None = None, reversible: bool | None = None, dt: str | TimeUnit = "1 step", active: Sequence[int] | None = None, n_full: int | None = None):
        self.p = np.asarray(p, float)
        if not np.allclose(self.p.sum(1), 1, atol=1e-8) or (self.p < -1e-12).any():
            raise ValueError("not a stochastic matrix")
        self._pi = pi
        self._reversible = reversible
        self.dt = TimeUnit.parse(dt)
        self.active = np.arange(len(self.p)) if active is None else np.asarray(active)
        self.n_full = n_full or int(self.active.max() + 1)
        self._spectrum: tuple | None = None

    @property
    def nstates(self) -> int:
        return len(self.p)

    @property
    def pi(self) -> np.ndarray:
        if self._pi is None:
            self._pi = stationary(self.p)
        return self._pi

    @property
    def reversible(self) -> bool:
        if self._reversible is None:
            x = self.pi[:, None] * self.p
            self._reversible = bool(np.allclose(x, x.T, atol=1e-10))
        return self._reversible

    def full_state(self, values: np.ndarray, default: float = 0.0, axes: Sequence[int] = (0,)) -> np.ndarray:
        return D.globalize(values, self.active, self.n_full, default, axes)

    def _decompose(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eigenvalues by descending modulus, right vectors (columns), left vectors (rows), with L R = 1."""
        if self._spectrum is None:
            if self.reversible and (self.pi > 0).all():
                r = np.sqrt(self.pi)
                s = r[:, None] * self.p / r
                values, v = np.linalg.eigh((s + s.T) / 2)
                order = np.argsort(-np.abs(values), kind="stable")
                values, v = values[order], v[:, order]
                right, left = v / r[:, None], (v * r[:, None]).T
                sign = np.sign(right[:, 0].sum()) or 1
                right[:, 0], left[0] = right[:, 0] * sign, left[0] * sign
            else:
                values, right = np.linalg.eig(self.p)
                order = np.argsort(-np.abs(values), kind="stable")
                values, right = values[order], right[:, order]
                left = np.linalg.inv(right)
                scale = left[0].sum()
                left[0], right[:, 0] = left[0] / scale, right[:, 0] * scale
                if np.allclose(values.imag, 0):
                    values, right, left = values.real, right.real, left.real
            self._spectrum = values, right, left
        return self._spectrum

    def eigenvalues(self, k: int | None = None) -> np.ndarray:
        return self._decompose()[0][:k]

    def eigenvectors_right(self, k: int | None = None) -> np.ndarray:
        return self._decompose()[1][:, :k]

    def eigenvectors_left(self, k: int | None = None) -> np.ndarray:
        return self._decompose()[2][:k]

    def timescales(self, k: int | None = None) -> np.ndarray:
        with np.errstate(divide="ignore"):
            t = -self.dt.factor / np.log(np.abs(self.eigenvalues()))[1:]
        return t[:k]

    def propagate(self, p0: np.ndarray, k: int) -> np.ndarray:
        p = np.asarray(p0, float) @ np.linalg.matrix_power(self.p, k)
        return p / p.sum()

    def _sets(self, a, b) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.atleast_1d(a), np.atleast_1d(b)
        if np.intersect1d(a, b).size:
            raise ValueError("the sets overlap")
        return a, b

    def mfpt(self, a, b) -> float:
        """Mean first passage time from ``a`` (weighted by pi) to ``b``."""
        a, b = np.atleast_1d(a), np.atleast_1d(b)
        m = np.eye(self.nstates) - self.p
        rhs = np.ones(self.nstates)
        m[b], rhs[b] = 0, 0
        m[b, b] = 1
        t = np.linalg.solve(m, rhs)
        w = self.pi[a]
        return float(self.dt.factor * (w @ t[a]) / w.sum())

    def committor_forward(self, a, b) -> np.ndarray:
        a, b = self._sets(a, b)
        return _committor(self.p, a, b)

    def committor_backward(self, a, b) -> np.ndarray:
        a, b = self._sets(a, b)
        back = (self.pi[:, None] * self.p).T / self.pi[:, None]
        return _committor(back, b, a)

    def expectation(self, a: np.ndarray) -> float:
        return float(np.dot(self.pi, a))

    def _times(self, maxtime: float | None) -> np.ndarray:
        if maxtime is None:
            maxtime = 5 * float(np.real(self.timescales(1)[0])) if self.nstates > 1 else 1.0
        return np.arange(int(np.ceil(maxtime / self.dt.factor)) + 1)

    def correlation(self, a: np.ndarray, b: np.ndarray | None = None, maxtime: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(times, <a(0) b(t)>)``; the default end is five of the slowest timescale."""
        b = np.asarray(a if b is None else b, float)
        values, right, left = self._decompose()
        steps = self._times(maxtime)
        amp = (self.pi * a @ right) * (left @ b)
        return steps * self.dt.factor, np.real((values[None, :] ** steps[:, None]) @ amp)

    def fingerprint_correlation(self, a, b=None, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        b = np.asarray(a if b is None else b, float)
        _, right, left = self._decompose()
        amp = (self.pi * a @ right) * (left @ b)
        return np.concatenate([[np.inf], self.timescales()])[:k], np.real(amp)[:k]

    def relaxation(self, p0, a, maxtime: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        values, right, left = self._decompose()
        steps = self._times(maxtime)
        amp = (np.asarray(p0) @ right) * (left @ np.asarray(a, float))
        return steps * self.dt.factor, np.real((values[None, :] ** steps[:, None]) @ amp)

    def fingerprint_relaxation(self, p0, a, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        _, right, left = self._decompose()
        amp = (np.asarray(p0) @ right) * (left @ np.asarray(a, float))
        return np.concatenate([[np.inf], self.timescales()])[:k], np.real(amp)[:k]

    def pcca(self, m: int) -> PCCA:
        if not self.reversible:
            raise ValueError("fuzzy clustering of states needs a reversible matrix")
        return PCCA(self, m)

    def simulate(self, n: int, start: int | None = None, stop=None, seed: int | None = None) -> np.ndarray:
        rng = np.random.default_rng(seed)
        ends = set(np.atleast_1d(stop).tolist()) if stop is not None else set()
        cum = np.cumsum(self.p, 1)
        state = int(rng.choice(self.nstates, p=self.pi / self.pi.sum())) if start is None else start
        out = [state]
        while len(out) < n and state not in ends:
            state = int(min(np.searchsorted(cum[state], rng.random() * cum[state, -1], side="right"), self.nstates - 1))
            out.append(state)
        return np.array(out)


def _committor(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = p - np.eye(len(p))
    rhs = np.zeros(len(p))
    for s, v in ((a, 0.0), (b, 1.0)):
        m[s] = 0
        m[s, s] = 1
        rhs[s] = v
    return np.clip(np.linalg.solve(m, rhs), 0, 1)


class PCCA:
    """Fuzzy metastable sets: a linear map of the dominant eigenvectors onto a simplex.

    The corners come from the inner-simplex search; the map is made feasible (memberships from 0 to 1 that sum to 1)
    and then improved for crispness by a simplex descent over its free entries.
    """

    def __init__(self, msm: MSM, m: int):
        self.msm, self.m = msm, m
        v = np.real(msm.eigenvectors_right(m)).copy()
        v[:, 0] = 1.0
        for k in range(1, m):  # unit norm under pi
            v[:, k] /= np.sqrt((msm.pi * v[:, k] ** 2).sum())
        corners = _inner_simplex(v)
        rot = np.linalg.inv(v[corners])
        if m > 1:
            rot = _crisp(v, rot)
        self.memberships = np.clip(v @ rot, 0, 1)
        self.memberships /= self.memberships.sum(1, keepdims=True)

    @property
    def assignment(self) -> np.ndarray:
        return self.memberships.argmax(1)

    @property
    def sets(self) -> list[np.ndarray]:
        return [np.flatnonzero(self.assignment == k) for k in range(self.m)]

    @property
    def coarse_stationary(self) -> np.ndarray:
        return self.msm.pi @ self.memberships

    @property
    def coarse_transition_matrix(self) -> np.ndarray:
        w = (self.memberships.T * self.msm.pi) @ self.memberships
        return np.linalg.inv(w) @ (self.memberships.T * self.msm.pi) @ self.msm.p @ self.memberships

    @property
    def output_probabilities(self) -> np.ndarray:
        b = (self.memberships * self.msm.pi[:, None]).T
        return b / b.sum(1, keepdims=True)


def _inner_simplex(v: np.ndarray) -> list[int]:
    """Rows of ``v`` that span the largest simplex, found one by one by distance from the span so far."""
    x = v - v[np.argmax((v[:, 1:] ** 2).sum(1))] if v.shape[1] > 1 else v
    first = int(np.argmax((v[:, 1:] ** 2).sum(1))) if v.shape[1] > 1 else 0
    out = [first]
    x = x[:, 1:].copy()
    for _ in range(1, v.shape[1]):
        k = int(np.argmax((x**2).sum(1)))
        out.append(k)
        u = x[k] / max(np.linalg.norm(x[k]), 1e-300)
        x = x - np.outer(x @ u, u)
    return out


def _feasible(v: np.ndarray, free: np.ndarray) -> np.ndarray:
    m = v.shape[1]
    rot = np.empty((m, m))
    rot[1:, 1:] = free.reshape(m - 1, m - 1)
    rot[1:, 0] = -rot[1:, 1:].sum(1)
    rot[0] = -(v[:, 1:] @ rot[1:]).min(0)
    return rot / rot[0].sum()


def _crisp(v: np.ndarray, rot: np.ndarray, steps: int = 400) -> np.ndarray:
    """Nelder-Mead on minus the crispness."""
    loss = lambda f: -((_feasible(v, f) ** 2).sum(0) / np.maximum(_feasible(v, f)[0], 1e-12)).sum()
    x0 = rot[1:, 1:].ravel()
    pts = [x0] + [x0 + np.eye(len(x0))[i] * (0.05 * abs(x0[i]) + 0.01) for i in range(len(x0))]
    val = [loss(p) for p in pts]
    for _ in range(steps * len(x0)):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) < 1e-12:
            break
        c = np.mean(pts[:-1], 0)
        r = 2 * c - pts[-1]
        fr = loss(r)
        if fr < val[0]:
            e = 3 * c - 2 * pts[-1]
            fe = loss(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            k = (c + pts[-1]) / 2
            fk = loss(k)
            if fk < val[-1]:
                pts[-1], val[-1] = k, fk
            else:
                pts = [pts[0]] + [(p + pts[0]) / 2 for p in pts[1:]]
                val = [val[0]] + [loss(p) for p in pts[1:]]
    return _feasible(v, pts[int(np.argmin(val))])


# Estimators


@dataclass
class MSMEstimator(Estimator):
    """From discrete trajectories to a model: core sets, counts at ``lag``, connected set, transition matrix."""

    lag: int = 1
    reversible: bool = True
    statdist: np.ndarray | None = None
    count_mode: str = "sliding"
    connectivity: str = "largest"
    mincount: float | str = "1/n"
    dt: str = "1 step"
    core_set: Sequence[int] | None = None
    milestoning: str = "last_core"
    model: MSM | None = None
    counts: np.ndarray | None = field(default=None, repr=False)

    def prepare(self, dtrajs: DataFrame) -> DataFrame:
        if self.core_set is None:
            return dtrajs
        if self.milestoning != "last_core":
            raise NotImplementedError("only the last core visited is supported")
        return D.core_set_milestones(dtrajs, self.core_set)

    def count(self, dtrajs: DataFrame) -> np.ndarray:
        dtrajs = self.prepare(dtrajs)
        counts = D.effective_counts(dtrajs, self.lag) if self.count_mode == "effective" else D.transition_counts(dtrajs, self.lag, self.count_mode)
        return D.counts_matrix(counts, D.number_of_states(dtrajs))

    def fit(self, dtrajs: DataFrame) -> MSMEstimator:
        return self.fit_counts(self.count(dtrajs))

    def fit_counts(self, c: np.ndarray) -> MSMEstimator:
        n = len(c)
        least = 1.0 / max(n, 1) if self.mincount == "1/n" else float(self.mincount)
        pi = None
        if self.statdist is not None:
            pi = np.asarray(self.statdist, float)
            keep = np.flatnonzero(pi > 0)
            sets = connected_sets(c[np.ix_(keep, keep)], least, strong=False)
            self.active = keep[sets[0]]
            pi = pi[self.active] / pi[self.active].sum()
        elif self.connectivity == "largest":
            self.active = connected_sets(c, least)[0]
        elif self.connectivity == "none":
            self.active = np.flatnonzero(c.sum(1) + c.sum(0) > 0)
        else:
            raise ValueError(f"unknown connectivity {self.connectivity}")
        sub = c[np.ix_(self.active, self.active)]
        if not len(self.active) or sub.sum() == 0:
            raise ValueError("the active set is empty: no transitions at this lag")
        self.counts, self.counts_active = c, sub
        p, pi = transition_matrix(sub, self.reversible, pi)
        self.model = MSM(p, pi, self.reversible or None, TimeUnit.parse(self.dt).scaled(self.lag), self.active, n)
        return self

    @property
    def active_state_fraction(self) -> float:
        return len(self.active) / len(self.counts)

    def active_count_fraction(self, dtrajs: DataFrame) -> float:
        return D.active_count_fraction(dtrajs, self.active)

    def dtrajs_active(self, dtrajs: DataFrame) -> DataFrame:
        return D.to_active(self.prepare(dtrajs), self.active)

    def trajectory_weights(self, dtrajs: DataFrame) -> DataFrame:
        return D.trajectory_weights(self.prepare(dtrajs), self.model.pi, self.active)

    def score(self, dtrajs: DataFrame, method: str = "VAMP2", rank: int | None = 10) -> float:
        """VAMP score of the model on test trajectories, in the training active set."""
        test = self.count(dtrajs)
        size = max(len(test), int(self.active.max()) + 1)
        wide = np.zeros((size, size))
        wide[: len(test), : len(test)] = test
        t = wide[np.ix_(self.active, self.active)]
        c = self.counts_active
        return vamp_score(None, np.diag(c.sum(1)), c, np.diag(c.sum(0)), np.diag(t.sum(1) + 1e-12), t, np.diag(t.sum(0) + 1e-12), rank, method) if t.sum() else 0.0

    def score_cv(self, dtrajs: DataFrame, n: int = 10, method: str = "VAMP2", rank: int | None = 10, block: int | None = None) -> np.ndarray:
        """Scores of ``n`` random halvings into training and test trajectories."""
        parts = D.block_split(dtrajs, block, self.lag) if block else dtrajs
        out = []
        for seed in range(n):
            halves = D.split_in_halves(parts, seed)
            train = MSMEstimator(self.lag, self.reversible, None, self.count_mode, self.connectivity, self.mincount).fit(halves.where("half = 0"))
            out.append(train.score(halves.where("half = 1"), method, rank))
        return np.array(out)

    def hmm(self, n: int, dtrajs: DataFrame):
        from kinelake.operators.hmm import HMSMEstimator

        t = self.model.timescales()
        if len(t) > n - 1 and np.real(t[n - 2] / t[n - 1]) < 1.5:
            import warnings

            warnings.warn(f"no gap between timescales {n - 1} and {n}", stacklevel=2)
        return HMSMEstimator(n, self.lag, reversible=self.reversible, dt=self.dt).fit(dtrajs)

    coarse_grain = hmm

    def cktest(self, dtrajs: DataFrame, nsets: int, multiples: Sequence[int] = tuple(range(1, 11)), memberships: np.ndarray | None = None) -> list[dict]:
        """Chapman-Kolmogorov test: ``{k, predicted, estimated}`` transition probabilities between metastable sets."""
        m = self.model.pcca(nsets).memberships if memberships is None else np.asarray(memberships)
        lags = [self.lag * k for k in multiples]
        counted = counts_by_lag(self.prepare(dtrajs), lags, self.count_mode)
        out = []
        for k, lag in zip(multiples, lags, strict=True):
            c = _resized(counted[lag], len(self.counts))[np.ix_(self.active, self.active)]
            try:
                p, _ = transition_matrix(c, self.reversible)
            except (ValueError, np.linalg.LinAlgError):
                continue
            pred = np.linalg.matrix_power(self.model.p, k)
            out.append({"k": k, "lag": lag, "predicted": _coarse(pred, self.model.pi, m), "estimated": _coarse(p, self.model.pi, m)})
        return out

    def eigenvalue_decay(self, dtrajs: DataFrame, n: int = 1, multiples: Sequence[int] = tuple(range(1, 11))) -> list[dict]:
        """Eigenvalues 2 .. n+1: the model's powers against new estimates at the multiples."""
        counted = counts_by_lag(self.prepare(dtrajs), [self.lag * k for k in multiples], self.count_mode)
        out = []
        for k in multiples:
            c = _resized(counted[self.lag * k], len(self.counts))[np.ix_(self.active, self.active)]
            p, pi = transition_matrix(c, self.reversible)
            out.append({"k": k, "predicted": self.model.eigenvalues(n + 1)[1:] ** k, "estimated": MSM(p, pi, self.reversible or None).eigenvalues(n + 1)[1:]})
        return out


def _resized(c: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[: len(c), : len(c)] = c[:n, :n]
    return out


def _coarse(p: np.ndarray, pi: np.ndarray, m: np.ndarray) -> np.ndarray:
    start = (m * pi[:, None]) / (pi @ m)
    return start.T @ p @ m


def counts_by_lag(dtrajs: DataFrame, lags: Sequence[int], mode: str = "sliding") -> dict[int, np.ndarray]:
    """Count matrices at several lags; sliding counts come from a single pass."""
    n = D.number_of_states(dtrajs)
    if mode != "sliding":
        make = D.effective_counts if mode == "effective" else lambda d, lag: D.transition_counts(d, lag, mode)
        return {lag: D.counts_matrix(make(dtrajs, lag), n) for lag in lags}
    rows = D.transition_counts_lags(dtrajs, sorted(set(lags))).collect()  # a row for each lag and pair of states
    out = {lag: np.zeros((n, n)) for lag in lags}
    for r in rows:
        out[r.lag][r.i, r.j] = r.n
    return out


def markov_model(p: np.ndarray, dt: str = "1 step") -> MSM:
    return MSM(p, dt=dt)


def estimate_markov_model(dtrajs: DataFrame, lag: int, weights: str = "empirical", **options) -> MSMEstimator:
    if weights == "oom":
        from kinelake.operators.oom import OOMEstimator

        return OOMEstimator(lag, **{k: v for k, v in options.items() if k in ("reversible", "dt", "mincount")}).fit(dtrajs)
    return MSMEstimator(lag, **options).fit(dtrajs)


@dataclass
class ImpliedTimescales(Estimator):
    """Timescales over lags; one pass counts all lags, and lags at which estimation fails are dropped."""

    lags: Sequence[int] | int | None = None
    nits: int | None = None
    reversible: bool = True
    connectivity: str = "largest"
    count_mode: str = "sliding"
    mincount: float | str = "1/n"
    dt: str = "1 step"
    nsamples: int = 0
    estimator: Callable[[np.ndarray, int], MSM] | None = None

    def fit(self, dtrajs: DataFrame) -> ImpliedTimescales:
        lags = self.lags
        if lags is None or isinstance(lags, int):
            longest = dtrajs.groupBy("traj_id").count().agg({"count": "max"}).first()[0]
            lags = generate_lags(lags or max(1, longest // 2 - 1))
        counted = counts_by_lag(dtrajs, lags, self.count_mode)
        self.kept, rows, self.models = [], [], []
        self.samples: list[np.ndarray | None] = []
        for lag in sorted(set(lags)):
            try:
                e = MSMEstimator(lag, self.reversible, None, self.count_mode, self.connectivity, self.mincount, self.dt).fit_counts(counted[lag])
                model = e.model
                if model.nstates < 2 or not np.isfinite(model.timescales(1)).all():
                    continue  # nothing decays, or the chain is periodic
            except (ValueError, np.linalg.LinAlgError, IndexError):
                continue
            self.kept.append(lag)
            self.models.append(model)
            rows.append(np.real(model.timescales(self.nits)))
            if self.nsamples:
                b = BayesianMSM(lag, self.nsamples, reversible=self.reversible, dt=self.dt).fit_counts(counted[lag] / (lag if self.count_mode == "sliding" else 1))
                self.samples.append(np.array([np.real(m.timescales(self.nits)) for m in b.models]))
        width = max(map(len, rows), default=0)
        self.timescales = np.array([np.append(r, np.full(width - len(r), np.nan)) for r in rows])
        return self

    def table(self, spark, conf: float = 0.95) -> DataFrame:
        """``lag, process, value, lo, hi``: what a plot of implied timescales shows."""
        out = []
        for k, lag in enumerate(self.kept):
            s = self.samples[k] if self.samples else None
            lo, hi = confidence_interval(s, conf) if s is not None and len(s) else (None, None)
            for j, v in enumerate(self.timescales[k]):
                if np.isfinite(v):
                    out.append((int(lag), j, float(v), float(lo[j]) if lo is not None else None, float(hi[j]) if hi is not None else None))
        return spark.createDataFrame(out, "lag int, process int, value double, lo double, hi double")


def timescales_msm(dtrajs: DataFrame, lags=None, **options) -> ImpliedTimescales:
    return ImpliedTimescales(lags, **options).fit(dtrajs)


@dataclass
class BayesianMSM(Estimator, Sampled):
    """Posterior samples of transition matrices around the maximum-likelihood model."""

    lag: int = 1
    nsamples: int = 100
    nsteps: int | None = None
    reversible: bool = True
    statdist: np.ndarray | None = None
    dt: str = "1 step"
    conf: float = 0.95
    mincount: float | str = "1/n"
    seed: int = 0

    def fit(self, dtrajs: DataFrame) -> BayesianMSM:
        return self.fit_counts(MSMEstimator(self.lag, count_mode="effective").count(dtrajs))

    def fit_counts(self, c: np.ndarray) -> BayesianMSM:
        e = MSMEstimator(self.lag, self.reversible, self.statdist, "effective", mincount=self.mincount, dt=self.dt).fit_counts(c)
        self.estimator, self.mle = e, e.model
        rng = np.random.default_rng(self.seed)
        c = e.counts_active
        steps = self.nsteps or max(1, int(np.sqrt(len(c))))
        self.models = []
        x = e.model.pi[:, None] * e.model.p
        for _ in range(self.nsamples):
            if self.reversible:
                x = sample_reversible(c, x, rng, steps, e.model.pi if self.statdist is not None else None)
                x = x / x.sum()
                p = x / x.sum(1, keepdims=True)
            else:
                p = sample_nonreversible(c, rng)
            self.models.append(MSM(p, None, self.reversible or None, e.model.dt, e.active, e.model.n_full))
        return self

    def table(self, spark) -> DataFrame:
        rows = [(k, i, j, float(m.p[i, j])) for k, m in enumerate(self.models) for i, j in np.argwhere(m.p > 0).tolist()]
        return spark.createDataFrame(rows, "sample int, i int, j int, p double")


def koopman_of_counts(c: np.ndarray) -> np.ndarray:
    """The whitened count matrix whose singular values VAMP scores sum."""
    return spd_inv_sqrt(np.diag(c.sum(1))) @ c @ spd_inv_sqrt(np.diag(c.sum(0)))


def generate_frames(msm: MSM, index: DataFrame, n: int, start: int | None = None, stop=None, stride: int = 1, seed: int = 42) -> DataFrame:
    """``pos, state, traj_id, t``: a simulated chain, each of its states represented by a random frame."""
    chain = msm.active[msm.simulate(n, start, stop, seed)[::stride]]
    return D.sample_by_sequence(index, chain.tolist(), seed)
