"""What estimators and sampled models share: parameters by name, and statistics over posterior samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields
from typing import Any

import numpy as np

from kinelake.functions.support import confidence_interval


class Estimator:
    """Parameters of a dataclass estimator by name."""

    def get_params(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.init}

    def set_params(self, **params: Any):
        unknown = params.keys() - self.get_params().keys()
        if unknown:
            raise ValueError(f"{type(self).__name__} has no parameters {sorted(unknown)}")
        for name, value in params.items():
            setattr(self, name, value)
        return self

    def estimate(self, data, **params: Any):
        """Set ``params`` and fit."""
        return self.set_params(**params).fit(data)


class Sampled:
    """Functions of every model in ``models``, and their mean, deviation and interval at ``conf``."""

    def sample_f(self, f: str | Callable, *args) -> np.ndarray:
        call = (lambda m: getattr(m, f)) if isinstance(f, str) else f
        got = [call(m) for m in self.models]
        return np.array([g(*args) if callable(g) else g for g in got])

    def sample_mean(self, f, *args) -> np.ndarray:
        return self.sample_f(f, *args).mean(0)

    def sample_std(self, f, *args) -> np.ndarray:
        return self.sample_f(f, *args).std(0)

    def sample_conf(self, f, *args) -> tuple[np.ndarray, np.ndarray]:
        return confidence_interval(self.sample_f(f, *args), self.conf)
