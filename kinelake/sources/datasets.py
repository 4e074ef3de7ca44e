"""Synthetic trajectories: a double well, umbrella and multi-temperature sampling, and Brownian motion in wells.

Every trajectory is drawn by its own seeded generator where its row is, so the data do not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.sources.frames import FRAMES, _frames_table


def double_well_matrix(n: int = 100, depth: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """A Metropolis chain over ``n`` bins of a quartic double well, and its stationary vector."""
    x = np.linspace(-1.5, 1.5, n)
    e = depth * (x**2 - 1) ** 2
    p = np.zeros((n, n))
    for i in range(n):
        for j in (i - 1, i + 1):
            if 0 <= j < n:
                p[i, j] = 0.5 * min(1.0, np.exp(e[i] - e[j]))
        p[i, i] = 1 - p[i].sum()
    pi = np.exp(-e)
    return p, pi / pi.sum()


def _drawn(spark: SparkSession, n: int, draw: Callable[[np.random.Generator, int], np.ndarray], seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                x = np.asarray(draw(np.random.default_rng([seed, i]), i), float)
                yield from _frames_table(i, x.reshape(len(x), -1)).to_batches()

    return spark.range(0, n, 1, min(n, 200)).mapInArrow(run, FRAMES)


def two_well_discrete(spark: SparkSession, n_traj: int = 1, length: int = 10_000, seed: int = 42) -> DataFrame:
    """Discrete trajectories of :func:`double_well_matrix`."""
    p, pi = double_well_matrix()
    cum = np.cumsum(p, 1)

    def draw(rng, _):
        out = np.empty(length)
        s = rng.choice(len(pi), p=pi)
        u = rng.random(length)
        for t in range(length):
            out[t] = s
            s = min(int(np.searchsorted(cum[s], u[t], side="right")), len(pi) - 1)
        return out

    return _drawn(spark, n_traj, draw, seed).select("traj_id", "t", F.get("x", F.lit(0)).cast("int").alias("state"))


def metropolis(rng: np.random.Generator, energy: Callable[[float], float], x0: float, length: int, step: float = 0.2, bounds: tuple[float, float] = (-2.0, 2.0), kt: float = 1.0) -> np.ndarray:
    """A Metropolis walk in a bounded potential."""
    out = np.empty(length)
    x, e = x0, energy(x0)
    moves, u = rng.normal(0, step, length), rng.random(length)
    for t in range(length):
        y = x + moves[t]
        if bounds[0] <= y <= bounds[1] and u[t] < np.exp(min(0.0, (e - (f := energy(y))) / kt)):
            x, e = y, f
        out[t] = x
    return out


def quartic_well(x: float) -> float:
    return 8 * (x**2 - 1) ** 2 / 4 + 0.5 * x


def umbrella_sampling(spark: SparkSession, ntherm: int = 11, force: float = 20.0, us_length: int = 500, md_length: int = 1000, nmd: int = 20, seed: int = 42) -> tuple[DataFrame, np.ndarray, np.ndarray, DataFrame]:
    """Umbrella trajectories, their centres and forces, and unbiased trajectories."""
    centers = np.linspace(-1.8, 1.8, ntherm)
    us = _drawn(spark, ntherm, lambda rng, i: metropolis(rng, lambda x: quartic_well(x) + 0.5 * force * (x - centers[i]) ** 2, centers[i], us_length), seed)
    md = _drawn(spark, nmd, lambda rng, i: metropolis(rng, quartic_well, -1.0 if i % 2 else 1.0, md_length), seed + 1)
    return us, centers, np.full(ntherm, force), md


def multi_temperature(spark: SparkSession, kt0: float = 1.0, kt1: float = 5.0, length0: int = 10_000, length1: int = 10_000, n0: int = 10, n1: int = 10, seed: int = 42) -> DataFrame:
    """``traj_id, t, x, energy, temp`` of walks at two temperatures."""

    def draw(rng, i):
        cold = i < n0
        x = metropolis(rng, quartic_well, -1.0, length0 if cold else length1, kt=kt0 if cold else kt1)
        return np.column_stack([x, quartic_well(x), np.full(len(x), kt0 if cold else kt1)])

    rows = _drawn(spark, n0 + n1, draw, seed)
    return rows.select("traj_id", "t", F.slice("x", 1, 1).alias("x"), F.get("x", F.lit(1)).alias("energy"), F.get("x", F.lit(2)).alias("temp"))


def brownian(rng: np.random.Generator, gradient: Callable[[np.ndarray], np.ndarray], x0: np.ndarray, steps: int, dt: float = 0.001, kt: float = 1.0, mass: float = 1.0, damping: float = 1.0, skip: int = 0) -> np.ndarray:
    """Overdamped Langevin motion by Euler steps; every ``skip + 1``-th position is kept."""
    a, b = dt / (mass * damping), np.sqrt(2 * dt * kt / (mass * damping))
    x = np.atleast_1d(np.asarray(x0, float)).copy()
    out = np.empty((steps, len(x)))
    for t in range(steps):
        out[t] = x
        for _ in range(skip + 1):
            x = x - a * gradient(x) + b * rng.normal(size=len(x))
    return out


def prinz_gradient(x: np.ndarray) -> np.ndarray:
    """Gradient of a one-dimensional potential of four wells: ``4 (x^8 + sum of Gaussians)``."""
    g = 8 * x**7
    for height, width, at in ((0.8, 80.0, 0.0), (0.2, 80.0, 0.5), (0.5, 40.0, -0.5)):
        g = g - 2 * width * (x - at) * height * np.exp(-width * (x - at) ** 2)
    return 4 * g


def folding_gradient(x: np.ndarray) -> np.ndarray:
    """Gradient of a radial folding potential: a narrow well inside ``r = 3``, a flat bowl outside."""
    r = max(np.linalg.norm(x), 1e-12)
    return x / r * (-5.0 * (r - 3.0) if r < 3 else 1.5 * (r - 3.0) ** 2 - 2.0 * (r - 3.0))


def double_well_2d_gradient(x: np.ndarray) -> np.ndarray:
    return np.array([4 * x[0] * (x[0] ** 2 - 1), 2 * x[1]])


def quadwell(spark: SparkSession, ntraj: int = 10, nstep: int = 10_000, x0: float = 0.0, nskip: int = 1, dt: float = 0.001, kt: float = 1.0, mass: float = 1.0, damping: float = 1.0, seed: int = 42) -> DataFrame:
    return _drawn(spark, ntraj, lambda rng, _: brownian(rng, prinz_gradient, np.array([x0]), nstep, dt, kt, mass, damping, nskip), seed)
