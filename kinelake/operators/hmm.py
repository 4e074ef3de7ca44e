"""Hidden Markov models of discrete trajectories.

The expectation step runs where the trajectories are: tasks hold whole (lagged, strided) trajectories and send back one
set of expected counts; the driver maximises and repeats.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions.linalg import connected_sets
from kinelake.functions.support import TimeUnit, confidence_interval
from kinelake.operators import dtrajs as D
from kinelake.operators.base import Estimator, Sampled
from kinelake.operators.msm import MSM, MSMEstimator, sample_nonreversible, sample_reversible, transition_matrix


class HMSM(MSM):
    """Hidden transition matrix ``p`` and output probabilities ``pobs`` (hidden x observed)."""

    def __init__(self, p, pobs, pi=None, reversible=None, dt="1 step", observable: Sequence[int] | None = None):
        super().__init__(p, pi, reversible, dt)
        self.pobs = np.asarray(pobs, float)
        self.observable = np.arange(self.pobs.shape[1]) if observable is None else np.asarray(observable)

    @property
    def lifetimes(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return -self.dt.factor / np.log(np.diag(self.p))

    def transition_matrix_obs(self, k: int = 1) -> np.ndarray:
        c = self.pobs.T @ (self.pi[:, None] * np.linalg.matrix_power(self.p, k)) @ self.pobs
        return c / c.sum(1, keepdims=True)

    @property
    def stationary_distribution_obs(self) -> np.ndarray:
        return self.pi @ self.pobs

    @property
    def eigenvectors_left_obs(self) -> np.ndarray:
        return self.eigenvectors_left() @ self.pobs

    @property
    def eigenvectors_right_obs(self) -> np.ndarray:
        return self.metastable_memberships @ self.eigenvectors_right()

    @property
    def metastable_memberships(self) -> np.ndarray:
        a = (self.pi[:, None] * self.pobs).T
        return a / np.maximum(a.sum(1, keepdims=True), 1e-300)

    @property
    def metastable_assignments(self) -> np.ndarray:
        return self.metastable_memberships.argmax(1)

    def _hidden(self, a: np.ndarray) -> np.ndarray:
        a = np.asarray(a, float)
        return a if len(a) == self.nstates and len(a) != self.pobs.shape[1] else self.pobs @ a

    def expectation(self, a):
        return super().expectation(self._hidden(a))

    def correlation(self, a, b=None, maxtime=None):
        return super().correlation(self._hidden(a), None if b is None else self._hidden(b), maxtime)

    def fingerprint_correlation(self, a, b=None, k=None):
        return super().fingerprint_correlation(self._hidden(a), None if b is None else self._hidden(b), k)

    def _start(self, p0: np.ndarray) -> np.ndarray:
        p0 = np.asarray(p0, float)
        return p0 if len(p0) == self.nstates else p0 @ self.metastable_memberships

    def relaxation(self, p0, a, maxtime=None):
        return super().relaxation(self._start(p0), self._hidden(a), maxtime)

    def fingerprint_relaxation(self, p0, a, k=None):
        return super().fingerprint_relaxation(self._start(p0), self._hidden(a), k)

    def propagate(self, p0, k: int):
        p0 = np.asarray(p0, float)
        p = super().propagate(self._start(p0), k)
        return p if len(p0) == self.nstates else p @ self.pobs

    def submodel(self, states: Sequence[int] | None = None, obs: Sequence[int] | None = None) -> HMSM:
        """Restricted to hidden and observed states, rows renormalised."""
        s = np.arange(self.nstates) if states is None else np.asarray(states)
        o = np.arange(self.pobs.shape[1]) if obs is None else np.asarray(obs)
        p, b = self.p[np.ix_(s, s)], self.pobs[np.ix_(s, o)]
        return HMSM(p / p.sum(1, keepdims=True), b / b.sum(1, keepdims=True), dt=self.dt, observable=self.observable[o])

    def simulate(self, n, start=None, stop=None, seed=None):
        """Hidden and observed path."""
        h = super().simulate(n, start, stop, seed)
        rng = np.random.default_rng(None if seed is None else seed + 1)
        cum = np.cumsum(self.pobs, 1)
        return h, np.array([min(np.searchsorted(cum[k], rng.random() * cum[k, -1], side="right"), cum.shape[1] - 1) for k in h])


def sequences(dtrajs: DataFrame, lag: int, stride: int = 1) -> DataFrame:
    """``traj_id, phase, states``: every trajectory as its ``lag / stride`` interleaved subsequences at distance ``lag``.

    A subsequence is cut where frames are unassigned or missing, so no two states that didn't follow each other become
    neighbours; each piece has a ``phase`` of its own.  A piece is an array in one row, of at most T / lag values for T frames.
    """
    rows = dtrajs.where("state >= 0").withColumn("phase", F.col("t") % lag).where(F.col("phase") % stride == 0)
    w = Window.partitionBy("traj_id", "phase").orderBy("t")
    after_gap = F.coalesce((F.col("t") - F.lag("t").over(w) != lag).cast("long"), F.lit(0))
    rows = rows.withColumn("gap", after_gap).withColumn("piece", F.sum("gap").over(w))
    got = rows.groupBy("traj_id", "phase", "piece").agg(F.array_sort(F.collect_list(F.struct("t", "state"))).alias("p"))
    return got.select("traj_id", (F.col("phase") + lag * F.col("piece")).alias("phase"), F.transform("p", lambda x: x["state"]).alias("states"))


def forward_backward(p: np.ndarray, b: np.ndarray, start: np.ndarray, obs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, state probabilities and expected transitions of one sequence."""
    n, k = len(obs), len(p)
    e = b[:, obs].T
    alpha, scale = np.empty((n, k)), np.empty(n)
    a = start * e[0]
    for t in range(n):
        if t:
            a = (alpha[t - 1] @ p) * e[t]
        scale[t] = max(a.sum(), 1e-300)
        alpha[t] = a / scale[t]
    beta = np.ones((n, k))
    for t in range(n - 2, -1, -1):
        beta[t] = p @ (e[t + 1] * beta[t + 1]) / scale[t + 1]
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    c = p * (alpha[:-1].T @ (e[1:] * beta[1:] / scale[1:, None])) if n > 1 else np.zeros((k, k))
    return float(np.log(scale).sum()), gamma, c


def expected_counts(p: np.ndarray, b: np.ndarray, start: np.ndarray, obs: np.ndarray, ends: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`forward_backward` summed over the sequences that end at ``ends`` in ``obs``: log-likelihood, first states, transitions, emissions.

    All sequences take a step together, the longest first, so a batch takes as many steps as its longest has frames.
    """
    k, m = b.shape
    begins = np.concatenate([[0], ends[:-1]])
    length = ends - begins
    order = np.argsort(-length, kind="stable")
    begins, length = begins[order[: np.count_nonzero(length)]], length[order[: np.count_nonzero(length)]]
    if not len(length):
        return 0.0, np.zeros(k), np.zeros((k, k)), np.zeros((k, m))
    running = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # how many have a frame t
    at = np.concatenate([[0], np.cumsum(running)])
    seen = obs[np.concatenate([begins[:r] + t for t, r in enumerate(running.tolist())])]  # frame by frame
    e = b.T[seen]
    alpha, beta, scale = np.empty((at[-1], k)), np.ones((at[-1], k)), np.empty(at[-1])
    for t, r in enumerate(running.tolist()):
        here = slice(at[t], at[t] + r)
        a = (start if t == 0 else alpha[at[t - 1] : at[t - 1] + r] @ p) * e[here]
        scale[here] = np.maximum(a.sum(1), 1e-300)
        alpha[here] = a / scale[here, None]
    trans = np.zeros((k, k))
    for t in range(len(running) - 1, 0, -1):
        here, before = slice(at[t], at[t + 1]), slice(at[t - 1], at[t - 1] + running[t])
        back = e[here] * beta[here] / scale[here, None]
        beta[before] = back @ p.T
        trans += alpha[before].T @ back
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    emit = np.stack([np.bincount(seen, g, m) for g in gamma.T])
    return float(np.log(scale).sum()), gamma[: running[0]].sum(0), p * trans, emit


def sample_path(p: np.ndarray, b: np.ndarray, start: np.ndarray, obs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    n, k = len(obs), len(p)
    alpha = np.empty((n, k))
    a = start * b[:, obs[0]]
    for t in range(n):
        if t:
            a = (alpha[t - 1] @ p) * b[:, obs[t]]
        alpha[t] = a / max(a.sum(), 1e-300)
    out = np.empty(n, int)
    out[-1] = rng.choice(k, p=alpha[-1] / alpha[-1].sum())
    for t in range(n - 2, -1, -1):
        w = alpha[t] * p[:, out[t + 1]]
        out[t] = rng.choice(k, p=w / w.sum())
    return out


STATS = "loglik double, first array<double>, trans array<double>, emit array<double>"


def _task_pass(seqs: DataFrame, p: np.ndarray, b: np.ndarray, start: np.ndarray, sample_seed: int | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Expected (or sampled) first states, transitions and emissions over all sequences: one row from each task."""
    k, m = b.shape
    shared = seqs.sparkSession.sparkContext.broadcast((p, b, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, b, start = shared.value
        ll, first, trans, emit = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros((k, m))
        for batch in batches:
            if sample_seed is None:
                states = batch.column(2)
                got = expected_counts(p, b, start, states.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(states).to_numpy(), dtype=np.int64))
                ll, first, trans, emit = (x + y for x, y in zip((ll, first, trans, emit), got, strict=True))
                continue
            for traj, phase, states in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                obs = np.array(states)
                path = sample_path(p, b, start, obs, np.random.default_rng([sample_seed, hash((traj, phase)) & 0x7FFFFFFF]))
                gamma, c = np.eye(k)[path], np.zeros((k, k))
                np.add.at(c, (path[:-1], path[1:]), 1)
                first += gamma[0]
                trans += c
                np.add.at(emit.T, obs, gamma)
        yield pa.RecordBatch.from_pylist([{"loglik": ll, "first": first.tolist(), "trans": trans.ravel().tolist(), "emit": emit.ravel().tolist()}], schema=pa.schema([("loglik", pa.float64()), *[(n, pa.list_(pa.float64())) for n in ("first", "trans", "emit")]]))

    total = [0.0, np.zeros(k), np.zeros(k * k), np.zeros(k * m)]
    for r in seqs.mapInArrow(run, STATS).toLocalIterator():
        for i, v in enumerate(r):
            total[i] = total[i] + (np.array(v) if i else v)
    return total[0], total[1], total[2].reshape(k, k), total[3].reshape(k, m)


@dataclass
class HMSMEstimator(Estimator):
    """Baum-Welch estimation, started from the metastable sets of a Markov model."""

    nstates: int = 2
    lag: int = 1
    stride: int | str = 1
    reversible: bool = True
    stationary: bool = False
    accuracy: float = 1e-3
    maxit: int = 1000
    mincount: float | str = "1/n"
    connectivity: str | None = None
    observe_nonempty: bool = True
    dt: str | TimeUnit = "1 step"
    model: HMSM | None = None

    def _sequences(self, dtrajs: DataFrame) -> DataFrame:
        stride = self.stride
        if stride == "effective":
            t = np.real(MSMEstimator(self.lag, self.reversible).fit(dtrajs).model.timescales(self.nstates - 1))
            stride = int(max(1, min(self.lag, 2 * t[-1]))) if len(t) and np.isfinite(t[-1]) else self.lag
        return sequences(dtrajs, self.lag, stride)

    def fit(self, dtrajs: DataFrame) -> HMSMEstimator:
        msm = MSMEstimator(self.lag, True, mincount=self.mincount).fit(dtrajs)
        n = D.number_of_states(dtrajs)
        pcca = msm.model.pcca(self.nstates)
        p = np.maximum(pcca.coarse_transition_matrix, 1e-8)
        p /= p.sum(1, keepdims=True)
        # Every state keeps some chance everywhere: expectation maximisation can't revive an output of probability 0.
        b = np.full((self.nstates, n), 1e-6)
        b[:, msm.active] += 0.9 * pcca.output_probabilities + 0.1 * msm.model.pi
        b /= b.sum(1, keepdims=True)
        start = MSM(p).pi
        seqs = self._sequences(dtrajs).persist()
        last = -np.inf
        self.likelihoods = []
        try:
            for _ in range(self.maxit):
                ll, first, trans, emit = _task_pass(seqs, p, b, start)
                self.likelihoods.append(ll)
                trans = np.maximum(trans, 1e-12)
                p, pi = transition_matrix(trans, self.reversible)
                b = np.maximum(emit, 1e-12)
                b /= b.sum(1, keepdims=True)
                start = pi if self.stationary else np.maximum(first, 1e-12) / np.maximum(first, 1e-12).sum()
                if ll - last < self.accuracy:
                    break
                last = ll
        finally:
            seqs.unpersist()
        self.counts, self.initial, self.emissions = trans, start, emit
        obs = np.flatnonzero(emit.sum(0) > 1e-9) if self.observe_nonempty else np.arange(n)
        b = b[:, obs] / b[:, obs].sum(1, keepdims=True)
        self.model = HMSM(p, b, None, self.reversible or None, TimeUnit.parse(self.dt).scaled(self.lag), obs)
        if self.connectivity:
            self.model = self.submodel(self.connectivity)
        return self

    def submodel(self, kind: str | Sequence[int] = "largest", obs: Sequence[int] | None = None) -> HMSM:
        """``largest`` or ``populous`` connected hidden states, ``disconnect`` for none joined, or given states."""
        if isinstance(kind, str):
            sets = connected_sets(self.counts, 1.0 / self.nstates if self.mincount == "1/n" else float(self.mincount))
            if kind == "disconnect":
                p = np.where(self.counts >= (1.0 / self.nstates if self.mincount == "1/n" else float(self.mincount)), self.model.p, 0)
                np.fill_diagonal(p, np.diag(self.model.p))
                return HMSM(p / p.sum(1, keepdims=True), self.model.pobs, dt=self.model.dt, observable=self.model.observable)
            kind = sets[0] if kind == "largest" else max(sets, key=lambda s: self.counts[np.ix_(s, s)].sum())
        return self.model.submodel(kind, obs)

    def trajectory_weights(self, dtrajs: DataFrame) -> DataFrame:
        """Frames of states that were never observed weigh 0."""
        return D.trajectory_weights(dtrajs, self.model.stationary_distribution_obs, self.model.observable)

    def sample_by_observation_probabilities(self, index: DataFrame, n: int, seed: int = 42) -> DataFrame:
        full = D.globalize(self.model.pobs, self.model.observable, int(self.model.observable.max()) + 1, 0.0, (1,))
        return D.sample_by_distributions(index, list(full), n, seed)


@dataclass
class BayesianHMSM(Estimator, Sampled):
    """Gibbs samples: hidden paths are drawn where the trajectories are, matrices on the driver."""

    nstates: int = 2
    lag: int = 1
    nsamples: int = 100
    stride: int | str = "effective"
    reversible: bool = True
    stationary: bool = False
    conf: float = 0.95
    dt: str | TimeUnit = "1 step"
    seed: int = 0

    def fit(self, dtrajs: DataFrame) -> BayesianHMSM:
        self.mle = HMSMEstimator(self.nstates, self.lag, self.stride, self.reversible, self.stationary, dt=self.dt).fit(dtrajs)
        rng = np.random.default_rng(self.seed)
        n = D.number_of_states(dtrajs)
        m = self.mle.model
        p, start = m.p, self.mle.initial
        b = D.globalize(m.pobs, m.observable, n, 1e-12, (1,))
        prior_c, prior_b = p / self.nstates, m.pobs.mean(0)
        prior_b = D.globalize(prior_b, m.observable, n, 0.0)
        seqs = self.mle._sequences(dtrajs).persist()
        self.models = []
        try:
            for k in range(self.nsamples):
                _, first, trans, emit = _task_pass(seqs, p, b, start, sample_seed=self.seed * 100003 + k)
                c = trans + prior_c
                if self.reversible:
                    base, pi = transition_matrix(c, True)
                    x = sample_reversible(c, pi[:, None] * base, rng, 10)
                    p = x / x.sum(1, keepdims=True)
                else:
                    p = sample_nonreversible(c, rng)
                b = np.array([rng.dirichlet(row) for row in emit + prior_b + 1e-6])
                start = MSM(p).pi if self.stationary else rng.dirichlet(first + 1.0 / self.nstates)
                o = m.observable
                self.models.append(HMSM(p, b[:, o] / b[:, o].sum(1, keepdims=True), None, self.reversible or None, m.dt, o))
        finally:
            seqs.unpersist()
        return self


def timescales_hmsm(dtrajs: DataFrame, nstates: int, lags: Sequence[int], **options) -> list[tuple[int, np.ndarray]]:
    """``(lag, timescales)`` of hidden models; lags at which estimation fails are dropped."""
    out = []
    for lag in lags:
        try:
            out.append((lag, np.real(HMSMEstimator(nstates, lag, **options).fit(dtrajs).model.timescales())))
        except (ValueError, np.linalg.LinAlgError):
            continue
    return out
