"""Linear models of lagged moments: PCA, TICA, VAMP, Koopman reweighting and column-sampled TICA.

Moments come from :mod:`kinelake.operators.moments`; what follows is eigenvalue algebra on d x d matrices.  A fitted
model maps frames in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions.linalg import eig_corr, spd_eig, spd_inv_sqrt, spd_inv_split
from kinelake.functions.support import vamp_score
from kinelake.operators.base import Estimator
from kinelake.operators.lag import lagged_pairs
from kinelake.operators.moments import Moments, _matrix, moments_lagged, moments_xx, pair_moments


def map_frames(frames: DataFrame, f: Callable[[np.ndarray], np.ndarray], column: str = "x") -> DataFrame:
    """Frames with ``x`` replaced by ``f`` of each Arrow batch's matrix; other columns stay."""
    names = frames.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = np.ascontiguousarray(f(_matrix(batch.column(at))), float)
                ends = np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]
                yield batch.set_column(at, pa.field(column, pa.list_(pa.float64())), pa.ListArray.from_arrays(ends, pa.array(y.ravel())))

    schema = ", ".join(f"{n} {'array<double>' if n == column else t}" for n, t in frames.dtypes)
    return frames.mapInArrow(run, schema)


def dimension_by_variance(cumulative: np.ndarray, cutoff: float) -> int:
    return int(min(len(cumulative), np.searchsorted(cumulative, cutoff) + 1))


@dataclass
class PCA(Estimator):
    dim: int = -1
    var_cutoff: float = 0.95
    mean: np.ndarray | None = None
    stride: int = 1
    skip: int = 0
    moments: Moments | None = None

    def __post_init__(self):
        if self.dim > -1 and self.var_cutoff < 1 and self.var_cutoff != 0.95:
            raise ValueError("give a dimension or a variance cutoff, not both")

    def fit(self, frames: DataFrame) -> PCA:
        self.moments = None
        return self.partial_fit(frames)

    def partial_fit(self, frames: DataFrame) -> PCA:
        from kinelake.sources.frames import strided

        m = moments_xx(strided(frames, self.stride, self.skip))
        self.moments = m if self.moments is None else self.moments.combine(m)
        values, vectors = np.linalg.eigh(self.moments.xx / (self.moments.w - 1))
        self.eigenvalues, self.eigenvectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        self.center = self.moments.mean_x if self.mean is None else np.asarray(self.mean, float)
        self.cumvar = np.cumsum(self.eigenvalues) / self.eigenvalues.sum()
        return self

    @property
    def dimension(self) -> int:
        return self.dim if self.dim > -1 else dimension_by_variance(self.cumvar, self.var_cutoff)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.center) @ self.eigenvectors[:, : self.dimension]

    def transform(self, frames: DataFrame) -> DataFrame:
        center, v = self.center, self.eigenvectors[:, : self.dimension]
        return map_frames(frames, lambda x: (x - center) @ v)

    @property
    def feature_correlation(self) -> np.ndarray:
        std = np.sqrt(np.diag(self.moments.xx) / (self.moments.w - 1))
        return self.eigenvectors * np.sqrt(self.eigenvalues) / std[:, None]


@dataclass
class Koopman(Estimator):
    """Equilibrium weights of frames from the Koopman operator's left fixed function: ``w(x) = x . u + u_const``."""

    lag: int
    epsilon: float = 1e-6
    stride: int = 1
    skip: int = 0
    moments: Moments | None = None

    def fit(self, frames: DataFrame) -> Koopman:
        self.moments = None
        return self.partial_fit(frames)

    def partial_fit(self, frames: DataFrame) -> Koopman:
        m = moments_lagged(frames, self.lag, stride=self.stride, skip=self.skip)
        self.moments = m = m if self.moments is None else self.moments.combine(m)
        r = spd_inv_split(m.xx / m.w, self.epsilon)
        k = np.eye(r.shape[1] + 1)
        k[:-1, :-1] = r.T @ (m.xy / m.w) @ r
        k[:-1, -1] = 0
        k[-1, :-1] = (m.mean_y - m.mean_x) @ r
        values, left = np.linalg.eig(k.T)
        u = np.real(left[:, np.abs(values - 1).argmin()])
        u = u / u[-1]
        self.u = r @ u[:-1]
        self.u_const = float(1 - m.mean_x @ self.u)
        return self

    def weights(self, frames: DataFrame, name: str = "w") -> DataFrame:
        u = F.array(*map(F.lit, self.u.tolist()))
        dot = F.aggregate(F.zip_with("x", u, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return frames.withColumn(name, dot + self.u_const)


@dataclass
class TICA(Estimator):
    """Slow linear combinations: maximal autocorrelation at ``lag``.

    ``kinetic_map`` scales by eigenvalues, ``commute_map`` by timescales; non-reversible models can have complex
    pairs, whose projections are real and imaginary parts side by side (``complex_struct`` gives structs).
    """

    lag: int = 10
    dim: int = -1
    var_cutoff: float = 0.95
    kinetic_map: bool = True
    commute_map: bool = False
    epsilon: float = 1e-6
    reversible: bool = True
    remove_mean: bool = True
    weights: str | Koopman | None = None
    stride: int = 1
    skip: int = 0
    moments: Moments | None = None

    def __post_init__(self):
        if self.kinetic_map and self.commute_map:
            raise ValueError("scale by kinetic map or by commute map")

    def fit(self, frames: DataFrame) -> TICA:
        self.moments = None
        return self.partial_fit(frames)

    def partial_fit(self, frames: DataFrame) -> TICA:
        weight = None
        if self.weights == "koopman":
            self.weights = Koopman(self.lag, self.epsilon, self.stride, self.skip).fit(frames)
        if isinstance(self.weights, Koopman):
            frames, weight = self.weights.weights(frames), "w"
        elif isinstance(self.weights, str):
            weight = self.weights
        m = moments_lagged(frames, self.lag, False, self.stride, self.skip, weight)
        self.moments = m if self.moments is None else self.moments.combine(m)
        return self._solve()

    def _solve(self) -> TICA:
        m = self.moments.symmetrized() if self.reversible else self.moments
        if not self.remove_mean:
            m = m.raw()
        self.mean = m.mean_x if self.remove_mean else np.zeros(len(m.sx))
        self.cov, self.cov_tau = m.xx / m.w, m.xy / m.w
        self.eigenvalues, self.eigenvectors = eig_corr(self.cov, self.cov_tau, self.epsilon)
        if self.kinetic_map:
            self.eigenvectors = self.eigenvectors * self.eigenvalues
        elif self.commute_map:
            self.eigenvectors = self.eigenvectors * np.sqrt(np.maximum(np.nan_to_num(np.real(self.timescales), posinf=0.0), 0) / 2)
        v = np.cumsum(np.abs(self.eigenvalues) ** 2)
        self.cumvar = v / v[-1]
        return self

    @property
    def timescales(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return -self.lag / np.log(np.abs(self.eigenvalues))

    @property
    def dimension(self) -> int:
        return min(self.dim, len(self.eigenvalues)) if self.dim > -1 else dimension_by_variance(self.cumvar, self.var_cutoff)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.eigenvectors[:, : self.dimension]

    def transform(self, frames: DataFrame) -> DataFrame:
        mean, v = self.mean, self.eigenvectors[:, : self.dimension]
        if np.iscomplexobj(v) and np.abs(v.imag).max(initial=0) > 0:
            return map_frames(frames, lambda x: np.stack([((y := (x - mean) @ v)).real, y.imag], 2).reshape(len(x), -1))
        v = np.real(v)
        return map_frames(frames, lambda x: (x - mean) @ v)

    @staticmethod
    def complex_struct(frames: DataFrame) -> DataFrame:
        """Interleaved parts as ``array<struct<re, im>>``."""
        pairs = F.transform(F.sequence(F.lit(0), F.size("x") / 2 - 1), lambda i: F.struct(F.get("x", (2 * i).cast("int")).alias("re"), F.get("x", (2 * i + 1).cast("int")).alias("im")))
        return frames.withColumn("x", pairs)

    @property
    def feature_correlation(self) -> np.ndarray:
        std = np.sqrt(np.diag(self.cov))
        raw = self.eigenvectors[:, : self.dimension]
        return (self.cov @ raw) / (std[:, None] * np.sqrt(np.abs(np.einsum("ij,ik,kj->j", raw, self.cov, raw))))


@dataclass
class VAMP(Estimator):
    """Singular functions of the Koopman operator between ``t`` and ``t + lag``."""

    lag: int = 10
    dim: int | float | None = None
    scaling: str | None = None
    right: bool = False
    epsilon: float = 1e-6
    stride: int = 1
    skip: int = 0
    moments: Moments | None = None

    def fit(self, frames: DataFrame) -> VAMP:
        self.moments = None
        return self.partial_fit(frames)

    def partial_fit(self, frames: DataFrame) -> VAMP:
        m = moments_lagged(frames, self.lag, stride=self.stride, skip=self.skip)
        self.moments = m if self.moments is None else self.moments.combine(m)
        return self._solve()

    def _solve(self) -> VAMP:
        m = self.moments
        self.mean_0, self.mean_t = m.mean_x, m.mean_y
        self.c00, self.c0t, self.ctt = m.xx / m.w, m.xy / m.w, m.yy / m.w
        l0, lt = spd_inv_split(self.c00, self.epsilon, True), spd_inv_split(self.ctt, self.epsilon, True)
        u, s, vt = np.linalg.svd(l0.T @ self.c0t @ lt, full_matrices=False)
        self.singular_values = s
        self.u, self.v = l0 @ u, lt @ vt.T
        v = np.cumsum(s**2)
        self.cumvar = v / v[-1] if len(v) else v
        return self

    @property
    def dimension(self) -> int:
        if isinstance(self.dim, float):
            return dimension_by_variance(self.cumvar, self.dim)
        return min(self.dim or len(self.singular_values), len(self.singular_values))

    def _map(self) -> tuple[np.ndarray, np.ndarray]:
        k = self.dimension
        scale = {None: np.ones(k), "km": self.singular_values[:k], "kinetic map": self.singular_values[:k]}[self.scaling]
        return (self.mean_t, self.v[:, :k] * scale) if self.right else (self.mean_0, self.u[:, :k] * scale)

    def project(self, x: np.ndarray) -> np.ndarray:
        mean, v = self._map()
        return (x - mean) @ v

    def transform(self, frames: DataFrame) -> DataFrame:
        mean, v = self._map()
        return map_frames(frames, lambda x: (x - mean) @ v)

    def score(self, test: VAMP | None = None, method: str = "VAMP2") -> float:
        """The score on test data's moments (default: the training data's), plus 1 for the constant."""
        t = test or self
        return 1.0 + vamp_score(None, self.c00, self.c0t, self.ctt, t.c00, t.c0t, t.ctt, self.dimension, method)

    def expectation(self, observables: np.ndarray, statistics: np.ndarray | None = None, lag_multiple: int = 1, mean_free: bool = False, statistics_mean_free: bool = False) -> np.ndarray:
        """Expected observables (or covariances with statistics) ``lag_multiple`` lags on.

        Observables and statistics are linear in the frames: a column for each, a row for each feature.
        """
        k = self.dimension
        u, v, s = self.u[:, :k], self.v[:, :k], np.diag(self.singular_values[:k])
        step = np.eye(k)
        # Left functions at the later time, expanded in the right ones, chain one step to the next.
        inner = v.T @ self.ctt @ u
        for _ in range(lag_multiple - 1):
            step = step @ s @ inner
        obs = np.atleast_2d(np.asarray(observables, float).T).T
        q = v.T @ self.ctt @ obs
        if statistics is None:
            return (0 if mean_free else self.mean_t @ obs)
        st = np.atleast_2d(np.asarray(statistics, float).T).T
        out = (st.T @ self.c00 @ u) @ step @ s @ q
        if not (mean_free or statistics_mean_free):
            out = out + np.outer(self.mean_0 @ st, self.mean_t @ obs)
        return out

    def cktest(self, frames: DataFrame, observables: np.ndarray, statistics: np.ndarray, multiples: Sequence[int] = (1, 2, 3)) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """``(multiple, predicted, estimated)`` expectations."""
        out = []
        for k in multiples:
            other = VAMP(self.lag * k, self.dim, epsilon=self.epsilon, stride=self.stride, skip=self.skip).fit(frames)
            out.append((k, self.expectation(observables, statistics, k), other.expectation(observables, statistics, 1)))
        return out


# Column-sampled TICA


def oasis_errors(c_k: np.ndarray, columns: Sequence[int], diagonal: np.ndarray) -> np.ndarray:
    """Diagonal error of the Nystroem approximation from the columns ``c_k`` of a symmetric matrix."""
    w = c_k[list(columns)]
    inv = np.linalg.pinv((w + w.T) / 2)
    return diagonal - np.einsum("ij,jk,ik->i", c_k, inv, c_k)


@dataclass
class NystroemTICA(Estimator):
    """TICA on columns of the covariances, chosen greedily where their Nystroem approximation errs most."""

    lag: int
    max_columns: int
    dim: int = -1
    var_cutoff: float = 0.95
    epsilon: float = 1e-6
    stride: int = 1
    skip: int = 0
    initial_columns: Sequence[int] | Callable[[int], Sequence[int]] | None = None
    n_select: int = 1
    strategy: str = "oasis"
    seed: int = 0
    columns: list[int] = field(default_factory=list)

    def fit(self, frames: DataFrame) -> NystroemTICA:
        pairs = lagged_pairs(frames, self.lag, stride=self.stride, skip=self.skip)
        d = frames.select(F.max(F.size("x"))).first()[0]
        start = self.initial_columns(d) if callable(self.initial_columns) else self.initial_columns
        rng = np.random.default_rng(self.seed)
        cols = list(start) if start is not None else [int(rng.integers(d))]
        diagonal = self._diagonal(pairs, d)
        while True:
            c0, ct, mean, w = self._columns(pairs, cols)
            error = oasis_errors(c0, cols, diagonal)
            error[cols] = 0
            room = min(self.max_columns, d) - len(cols)
            if room <= 0 or np.abs(error).max() <= self.epsilon * diagonal.max():
                break
            cols += self._choose(error, c0, cols, min(self.n_select, room), rng)
        self.columns, self.mean = cols, mean
        w0 = c0[cols]
        s, q = spd_eig((w0 + w0.T) / 2, self.epsilon)
        root = q / np.sqrt(s)
        lead = c0 @ root  # C0 is approximated by lead lead'
        inner0 = lead.T @ lead
        wt = ct[cols]
        left = np.linalg.pinv(lead)
        kt = left @ ct @ np.linalg.pinv((wt + wt.T) / 2) @ ct.T @ left.T
        values, vectors = np.linalg.eigh((kt + kt.T) / 2)
        order = np.argsort(-np.abs(values))
        self.eigenvalues = values[order]
        self.eigenvectors = lead @ np.linalg.inv(inner0) @ vectors[:, order]
        v = np.cumsum(self.eigenvalues**2)
        self.cumvar = v / v[-1]
        return self

    def _diagonal(self, pairs: DataFrame, d: int) -> np.ndarray:
        long = pairs.select(F.posexplode(F.arrays_zip("x", "y")).alias("i", "p")).groupBy("i").agg(F.avg("p.x").alias("mx"), F.avg("p.y").alias("my"), F.avg(F.col("p.x") ** 2 + F.col("p.y") ** 2).alias("q"))
        rows = {r[0]: r for r in long.collect()}  # a row for each feature
        return np.array([rows[i].q / 2 - ((rows[i].mx + rows[i].my) / 2) ** 2 for i in range(d)])

    def _columns(self, pairs: DataFrame, cols: Sequence[int]):
        pick = lambda c: F.array(*[F.get(c, F.lit(int(k))) for k in cols])
        m = pair_moments(pairs.select(F.col("x"), F.concat(pick("x"), F.col("y"), pick("y")).alias("z")), "x", "z")
        back = pair_moments(pairs.select(F.col("y").alias("x"), F.concat(pick("x"), pick("y")).alias("z")), "x", "z")
        k, d = len(cols), len(m.sx)
        mean = (m.mean_x + m.mean_y[k : k + d]) / 2
        mc = mean[list(cols)]
        f, b = m.raw(), back.raw()
        n = 2 * f.w
        c0 = (f.xy[:, :k] + b.xy[:, k:]) / n - np.outer(mean, mc)
        ct = (f.xy[:, k + d :] + b.xy[:, :k]) / n - np.outer(mean, mc)
        return c0, ct, mean, n

    def _choose(self, error: np.ndarray, c0: np.ndarray, cols: list[int], n: int, rng) -> list[int]:
        rest = [i for i in range(len(error)) if i not in cols]
        if self.strategy == "random":
            return rng.choice(rest, n, replace=False).tolist()
        order = np.argsort(-np.abs(error), kind="stable")
        if self.strategy == "oasis":
            return [int(i) for i in order if i in set(rest)][:n]
        if self.strategy != "spectral-oasis":
            raise ValueError(f"unknown strategy {self.strategy}")
        pool = [int(i) for i in order if i in set(rest)][: max(10 * n, n)]
        w = c0[cols]
        s, q = spd_eig((w + w.T) / 2, self.epsilon)
        spectral = c0 @ q / np.sqrt(s)
        chosen = pool[:1]
        while len(chosen) < min(n, len(pool)):
            far = [min(np.linalg.norm(spectral[i] - spectral[j]) for j in chosen) if i not in chosen else -1 for i in pool]
            chosen.append(pool[int(np.argmax(far))])
        return chosen

    @property
    def dimension(self) -> int:
        return self.dim if self.dim > -1 else dimension_by_variance(self.cumvar, self.var_cutoff)

    @property
    def timescales(self) -> np.ndarray:
        return -self.lag / np.log(np.abs(self.eigenvalues))

    def transform(self, frames: DataFrame) -> DataFrame:
        mean, v = self.mean, self.eigenvectors[:, : self.dimension]
        return map_frames(frames, lambda x: (x - mean) @ v)


def koopman_matrix(c00: np.ndarray, c0t: np.ndarray, ctt: np.ndarray, epsilon: float = 1e-6) -> np.ndarray:
    return spd_inv_sqrt(c00, epsilon) @ c0t @ spd_inv_sqrt(ctt, epsilon)
