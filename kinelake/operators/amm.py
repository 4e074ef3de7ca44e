"""Augmented Markov models: the most likely reversible matrix whose averages agree with experiments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from kinelake.functions.support import TimeUnit
from kinelake.operators import dtrajs as D
from kinelake.operators.msm import MSM, MSMEstimator, mle_fixed_pi


def state_expectations(dtrajs: DataFrame, frames: DataFrame, n: int) -> np.ndarray:
    """``E[state, observable]``: mean of each frame-wise observable over each state's frames."""
    from pyspark.sql import functions as F

    long = dtrajs.join(frames, ["traj_id", "t"]).where("state >= 0").select("state", F.posexplode("x").alias("k", "v"))
    rows = long.groupBy("state", "k").agg(F.avg("v").alias("m")).collect()  # states x observables
    out = np.zeros((n, 1 + max((r.k for r in rows), default=0)))
    for r in rows:
        out[r.state, r.k] = r.m
    return out


@dataclass
class AugmentedMSM:
    """Observables ``e`` (states x observables) with experimental means ``m`` and deviations ``sigma``.

    The stationary vector is the unbiased one times ``exp(e . multipliers)``; multipliers climb the sum of the path
    likelihood and the Gaussian likelihood of the experiments by damped Newton steps.
    """

    lag: int
    e: np.ndarray
    m: np.ndarray
    sigma: np.ndarray
    maxiter: int = 500
    eps: float = 1e-8
    dt: str = "1 step"

    def fit(self, dtrajs: DataFrame) -> AugmentedMSM:
        return self.fit_msm(MSMEstimator(self.lag, True).fit(dtrajs))

    def fit_msm(self, est: MSMEstimator) -> AugmentedMSM:
        e, m, s = self.e[est.active], np.asarray(self.m, float), np.asarray(self.sigma, float)
        base, c = est.model.pi, est.counts_active
        lam = np.zeros(len(m))
        w = 1 / (2 * s**2)

        def tilted(lam):
            z = e @ lam
            p = base * np.exp(z - z.max())
            return p / p.sum()

        def objective(lam):
            pi = tilted(lam)
            p = mle_fixed_pi(c, pi, 2000, 1e-9)
            seen = c > 0
            return float((c[seen] * np.log(np.maximum(p[seen], 1e-300))).sum() - (w * (pi @ e - m) ** 2).sum()), pi, p

        best, pi, p = objective(lam)
        self.likelihoods = [best]
        for _ in range(self.maxiter):
            mean = pi @ e
            cov = (e * pi[:, None]).T @ e - np.outer(mean, mean)
            # Gradient of the experimental part, and of the path part by differences along each multiplier.
            grad = np.array([(objective(lam + h)[0] - objective(lam - h)[0]) / (2e-4) for h in 1e-4 * np.eye(len(lam))])
            hess = 2 * cov @ np.diag(w) @ cov + c.sum() * cov / len(c) + 1e-9 * np.eye(len(lam))
            step = np.linalg.solve(hess, grad)
            scale = 1.0
            while scale > 1e-6:
                value, pi2, p2 = objective(lam + scale * step)
                if value > best:
                    break
                scale /= 2
            else:
                break
            gain, best, lam, pi, p = value - best, value, lam + scale * step, pi2, p2
            self.likelihoods.append(best)
            if gain < self.eps * max(1.0, abs(best)):
                break
        self.multipliers, self.expectations = lam, pi @ e
        self.model = MSM(p, pi, True, TimeUnit.parse(self.dt).scaled(self.lag), est.active, est.model.n_full)
        return self


def estimate_augmented_markov_model(dtrajs: DataFrame, frames: DataFrame, lag: int, m, sigmas, **options) -> AugmentedMSM:
    n = D.number_of_states(dtrajs)
    return AugmentedMSM(lag, state_expectations(dtrajs, frames, n), np.asarray(m), np.asarray(sigmas), **options).fit(dtrajs)
