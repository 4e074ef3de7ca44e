"""One function for each kind of analysis, over ``frames`` and ``dtrajs`` DataFrames.

Every function returns the fitted object; its ``transform`` (or ``model``) is lazy where Spark is.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from kinelake.functions.features import Featurizer, read_atoms
from kinelake.operators import amm, clustering, decomposition, hmm, moments, msm, thermo
from kinelake.operators import statistics as stats
from kinelake.operators.tpt import tpt
from kinelake.plans.pipeline import Discretizer, Pipeline
from kinelake.sources import frames as fr
from kinelake.sources.frames import save_traj, save_trajs, source

__all__ = [
    "assign_to_centers", "bayesian_hidden_markov_model", "bayesian_markov_model", "cluster_kmeans", "cluster_mini_batch_kmeans", "cluster_regspace", "cluster_uniform_time", "combine_sources",
    "covariance_lagged", "discretizer", "dtram", "estimate_augmented_markov_model", "estimate_hidden_markov_model", "estimate_markov_model", "estimate_multi_temperature", "estimate_umbrella_sampling",
    "featurizer", "histogram", "load", "markov_model", "mbar", "pca", "pipeline", "save_traj", "save_trajs", "source", "tica", "tica_nystroem", "timescales_hmsm", "timescales_msm", "tpt", "tram", "vamp", "wham",
]


# Coordinates


def featurizer(topology: Any) -> Featurizer:
    """Features over an atom table: a pandas DataFrame, or the name of a PDB file."""
    return Featurizer(read_atoms(topology) if isinstance(topology, str) else topology)


def load(spark: SparkSession, files, features: Featurizer | None = None, stride: int = 1) -> list[np.ndarray]:
    """Trajectories in the driver's memory."""
    df = source(spark, files)
    return fr.get_output(features.transform(df) if features else df, stride=stride)


def combine_sources(sources: Sequence[DataFrame]) -> DataFrame:
    return fr.merge_sources(*sources)


def pipeline(frames: DataFrame, stages: Sequence[Any], stride: int = 1, run: bool = True) -> Pipeline:
    p = Pipeline(list(stages), stride)
    return p.fit(frames) if run else p


def discretizer(frames: DataFrame, transform: Any | None = None, cluster: Any | None = None, stride: int = 1) -> Discretizer:
    return Discretizer(transform, cluster or clustering.KMeans(100), stride).fit(frames)


def covariance_lagged(frames: DataFrame, lag: int = 0, remove_mean: bool = False, constant_mean=None, reversible: bool = False, bessel: bool = True, weights: str | None = None, stride: int = 1, skip: int = 0, columns=None, diag_only: bool = False) -> moments.LaggedCovariance:
    """``weights`` is a column of ``frames``, or ``koopman`` for equilibrium weights at this lag."""
    if weights == "koopman":
        frames, weights = decomposition.Koopman(lag, stride=stride, skip=skip).fit(frames).weights(frames), "w"
    remove = np.asarray(constant_mean, float) if constant_mean is not None else "data" if remove_mean else "none"
    return moments.LaggedCovariance(lag, reversible, bessel, remove, stride, skip, weights, columns, diag_only).fit(frames)


def pca(frames: DataFrame, dim: int = -1, var_cutoff: float = 0.95, **options) -> decomposition.PCA:
    return decomposition.PCA(dim, var_cutoff, **options).fit(frames)


def tica(frames: DataFrame, lag: int = 10, dim: int = -1, var_cutoff: float = 0.95, **options) -> decomposition.TICA:
    return decomposition.TICA(lag, dim, var_cutoff, **options).fit(frames)


def vamp(frames: DataFrame, lag: int = 10, dim: int | float | None = None, **options) -> decomposition.VAMP:
    return decomposition.VAMP(lag, dim, **options).fit(frames)


def tica_nystroem(frames: DataFrame, max_columns: int, lag: int = 10, **options) -> decomposition.NystroemTICA:
    return decomposition.NystroemTICA(lag, max_columns, **options).fit(frames)


def cluster_kmeans(frames: DataFrame, k: int | None = None, max_iter: int = 10, **options) -> clustering.KMeans:
    return clustering.KMeans(k, max_iter, **options).fit(frames)


def cluster_mini_batch_kmeans(frames: DataFrame, k: int = 100, max_iter: int = 10, batch_size: float = 0.2, **options) -> clustering.MiniBatchKMeans:
    return clustering.MiniBatchKMeans(k, max_iter, batch_size, **options).fit(frames)


def cluster_regspace(frames: DataFrame, dmin: float, max_centers: int = 1000, metric: str = "euclidean", **options) -> clustering.RegularSpace:
    return clustering.RegularSpace(dmin, max_centers, metric, **options).fit(frames)


def cluster_uniform_time(frames: DataFrame, k: int, metric: str = "euclidean", **options) -> clustering.UniformTime:
    return clustering.UniformTime(k, metric, **options).fit(frames)


def assign_to_centers(frames: DataFrame, centers, metric: str = "euclidean", stride: int = 1, skip: int = 0) -> DataFrame:
    return clustering.AssignCenters(centers, metric, stride, skip).transform(frames)


def histogram(frames: DataFrame, dimensions: Sequence[int], bins: Sequence[int]) -> DataFrame:
    return stats.histogram_nd(frames, dimensions, bins)


# Markov models


def markov_model(p: np.ndarray, dt: str = "1 step") -> msm.MSM:
    return msm.markov_model(p, dt)


def estimate_markov_model(dtrajs: DataFrame, lag: int, weights: str = "empirical", **options):
    return msm.estimate_markov_model(dtrajs, lag, weights, **options)


def bayesian_markov_model(dtrajs: DataFrame, lag: int, nsamples: int = 100, **options) -> msm.BayesianMSM:
    return msm.BayesianMSM(lag, nsamples, **options).fit(dtrajs)


def timescales_msm(dtrajs: DataFrame, lags=None, errors: str | None = None, nsamples: int = 50, **options) -> msm.ImpliedTimescales:
    return msm.timescales_msm(dtrajs, lags, nsamples=nsamples if errors == "bayes" else 0, **options)


def estimate_hidden_markov_model(dtrajs: DataFrame, nstates: int, lag: int, **options) -> hmm.HMSMEstimator:
    return hmm.HMSMEstimator(nstates, lag, **options).fit(dtrajs)


def bayesian_hidden_markov_model(dtrajs: DataFrame, nstates: int, lag: int, nsamples: int = 100, **options) -> hmm.BayesianHMSM:
    return hmm.BayesianHMSM(nstates, lag, nsamples, **options).fit(dtrajs)


def timescales_hmsm(dtrajs: DataFrame, nstates: int, lags: Sequence[int], **options) -> list[tuple[int, np.ndarray]]:
    return hmm.timescales_hmsm(dtrajs, nstates, lags, **options)


def estimate_augmented_markov_model(dtrajs: DataFrame, frames: DataFrame, lag: int, m, sigmas, **options) -> amm.AugmentedMSM:
    return amm.estimate_augmented_markov_model(dtrajs, frames, lag, m, sigmas, **options)


# Free energies


def estimate_umbrella_sampling(us: DataFrame, us_dtrajs: DataFrame, centers, forces, md: DataFrame | None = None, md_dtrajs: DataFrame | None = None, **options):
    return thermo.estimate_umbrella_sampling(us, us_dtrajs, centers, forces, md, md_dtrajs, **options)


def estimate_multi_temperature(energies: DataFrame, dtrajs: DataFrame, **options):
    return thermo.estimate_multi_temperature(energies, dtrajs, **options)


def wham(samples: DataFrame, **options) -> thermo.MultiThermModel:
    return thermo.estimate(samples, "wham", **options)


def mbar(samples: DataFrame, **options) -> thermo.MultiThermModel:
    return thermo.estimate(samples, "mbar", **options)


def dtram(samples: DataFrame, lag: int | Sequence[int], unbiased: int | None = None, **options):
    return thermo.estimate(samples, "dtram", lag, unbiased, **options)


def tram(samples: DataFrame, lag: int | Sequence[int], unbiased: int | None = None, **options):
    return thermo.estimate(samples, "tram", lag, unbiased, **options)
