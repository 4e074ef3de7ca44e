"""Chains of stages over frames: each is fitted on the output of those before it, and maps what it is given."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark.sql import DataFrame

from kinelake.operators.clustering import KMeans
from kinelake.sources.frames import strided


@dataclass
class Pipeline:
    """``fit`` fits stage after stage; with ``persist`` a stage's output is kept while the next is fitted on it."""

    stages: list[Any]
    stride: int = 1
    persist: bool = True
    fitted: bool = False

    def fit(self, frames: DataFrame) -> Pipeline:
        data, kept = strided(frames, self.stride), []
        for i, stage in enumerate(self.stages):
            stage.fit(data)
            if i < len(self.stages) - 1:
                data = stage.transform(data)
                if self.persist:
                    data = data.persist()
                    kept.append(data)
        for df in kept:
            df.unpersist()
        self.fitted = True
        return self

    def transform(self, frames: DataFrame) -> DataFrame:
        if not self.fitted:
            raise ValueError("fit the pipeline first")
        for stage in self.stages:
            frames = stage.transform(frames)
        return frames

    def __getitem__(self, i: int):
        return self.stages[i]

    def append(self, stage) -> None:
        self.stages.append(stage)
        self.fitted = False


@dataclass
class Discretizer:
    """Frames to discrete trajectories: an optional transformation, then a clustering (default: 100 means)."""

    transform: Any | None = None
    cluster: Any = field(default_factory=lambda: KMeans(100))
    stride: int = 1

    def fit(self, frames: DataFrame) -> Discretizer:
        self.pipeline = Pipeline([s for s in (self.transform, self.cluster) if s is not None], self.stride).fit(frames)
        return self

    def dtrajs(self, frames: DataFrame) -> DataFrame:
        return self.pipeline.transform(frames).select("traj_id", "t", "state")


def param_grid(**options: Iterable) -> list[dict]:
    return [dict(zip(options, values, strict=True)) for values in product(*options.values())]


def estimate_param_scan(make: Callable[..., Any], data: DataFrame, params: list[dict], evaluate: Callable[[Any], Any] | str | None = None, failfast: bool = True, n_jobs: int = 4) -> list:
    """An estimator for each set of parameters; the jobs run side by side on the cluster."""

    def one(p: dict):
        try:
            e = make(**p).fit(data)
        except Exception as err:
            if failfast:
                raise
            return err
        if evaluate is None:
            return e
        got = getattr(e, evaluate) if isinstance(evaluate, str) else evaluate(e)
        return got() if isinstance(evaluate, str) and callable(got) else got

    with ThreadPoolExecutor(n_jobs) as pool:
        return list(pool.map(one, params))
