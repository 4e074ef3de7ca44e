"""Units, sizes, index helpers, intervals, scores: small things that shape results."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from kinelake.functions.linalg import spd_inv_sqrt

#: Seconds of each unit; a step has none.
SECONDS = {"fs": 1e-15, "ps": 1e-12, "ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0}


@dataclass(frozen=True)
class TimeUnit:
    """A physical time per step, such as ``10 ns``."""

    factor: float = 1.0
    unit: str = "step"

    @classmethod
    def parse(cls, text: str | TimeUnit) -> TimeUnit:
        if isinstance(text, TimeUnit):
            return text
        parts = text.strip().lower().split()
        if len(parts) == 1 and (m := re.fullmatch(r"([\d.eE+-]+)?([a-z]+)", parts[0])):
            parts = [m[1] or "1", m[2]]
        name = {"steps": "step"}.get(parts[1], parts[1])
        if name != "step" and name not in SECONDS:
            raise ValueError(f"unknown time unit {parts[1]}")
        return cls(float(parts[0]), name)

    def __str__(self) -> str:
        return f"{self.factor:g} {self.unit}"

    def scaled(self, steps: float) -> TimeUnit:
        return TimeUnit(self.factor * steps, self.unit)

    def rescaled(self, times: Sequence[float]) -> tuple[np.ndarray, str]:
        """``times`` in the unit that brings their mean nearest to 1, and that unit."""
        values = np.asarray(times, float) * self.factor
        if self.unit == "step" or not np.isfinite(values).any():
            return values, self.unit
        mean = np.nanmean(values) * SECONDS[self.unit]
        best = min(SECONDS, key=lambda u: abs(np.log10(mean / SECONDS[u]))) if mean > 0 else self.unit
        return values * SECONDS[self.unit] / SECONDS[best], best


def string_to_bytes(text: str) -> int:
    """``256m`` as a number of bytes (1024-fold steps)."""
    m = re.fullmatch(r"\s*([\d.]+)\s*([kmgtp]?)i?b?\s*", str(text).lower())
    if not m:
        raise ValueError(f"no size: {text!r}")
    return int(float(m[1]) * 1024 ** " kmgtp".index(m[2] or " "))


def bytes_to_string(n: float, suffix: str = "B") -> str:
    for unit in ("", "Ki", "Mi", "Gi", "Ti"):
        if abs(n) < 1024:
            return f"{n:.1f}{unit}{suffix}"
        n /= 1024
    return f"{n:.1f}Pi{suffix}"


def array_hash(x: np.ndarray) -> str:
    """A digest of an array's shape, type and values."""
    x = np.ascontiguousarray(x)
    return hashlib.blake2b(x.tobytes(), digest_size=16, key=f"{x.shape}{x.dtype.str}".encode()[:64]).hexdigest()


def n_chunks(length: int, chunk: int, stride: int = 1, skip: int = 0) -> int:
    """Chunks of ``chunk`` frames that hold a trajectory after stride and skip; a chunk of 0 is the whole trajectory."""
    left = max(0, -(-(length - skip) // stride))
    return -(-left // chunk) if chunk else int(left > 0)


def register_lag_times(spark, name: str = "lag_times") -> None:
    """A SQL table function ``lag_times(maxlag, multiplier)``: rows ``lag`` of :func:`generate_lags`."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="lag: int")
    class LagTimes:
        def eval(self, maxlag: int, multiplier: float):
            for lag in generate_lags(maxlag, float(multiplier)):
                yield (int(lag),)

    spark.udtf.register(name, LagTimes)


def combinations(seq, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(seq, k)))


def product(*arrays) -> np.ndarray:
    return np.array(list(itertools.product(*arrays)))


def generate_lags(maxlag: int, multiplier: float = 1.5) -> list[int]:
    """1, then each lag times ``multiplier`` rounded half up, and ``maxlag`` last."""
    lags, x = [1], 1.0
    while (x := x * multiplier) <= maxlag:
        lag = int(np.floor(x + 0.5))
        if lag > lags[-1] and lag <= maxlag:
            lags.append(lag)
        x = float(lags[-1]) if lag == lags[-1] else x
    if lags[-1] != maxlag:
        lags.append(maxlag)
    return lags


def confidence_interval(data, conf: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """The interval around the mean that holds ``conf / 2`` of the samples on either side of it, per element."""
    a = np.asarray(data, float)
    flat = a.reshape(len(a), -1)
    lo, hi = np.empty(flat.shape[1]), np.empty(flat.shape[1])
    for k in range(flat.shape[1]):
        x = np.sort(flat[:, k])
        mean = x.mean()
        place = np.interp(mean, x, np.arange(len(x))) if x[0] < x[-1] else (len(x) - 1) / 2
        lo[k] = np.interp(place - conf * place, np.arange(len(x)), x)
        hi[k] = np.interp(place + conf * (len(x) - 1 - place), np.arange(len(x)), x)
    return lo.reshape(a.shape[1:]), hi.reshape(a.shape[1:])


def statistical_inefficiency(trajs, truncate: bool = True, mean_free: bool = False) -> float:
    """``1 / (2 tau)``: the share of independent samples in correlated series.

    The normaliser is the raw second moment unless ``mean_free`` is set, as users of the classic estimator expect.
    """
    xs = [np.asarray(x, float) for x in (trajs if isinstance(trajs, (list, tuple)) else [trajs])]
    mean = np.concatenate(xs).mean()
    norm = np.mean(np.concatenate(xs - mean if mean_free and len(xs) == 1 else [x - mean if mean_free else x for x in xs]) ** 2)
    longest = max(map(len, xs))
    total = 0.0
    for lag in range(longest):
        num = sum(float(((x[: len(x) - lag] - mean) * (x[lag:] - mean)).sum()) for x in xs if len(x) > lag)
        n = sum(len(x) - lag for x in xs if len(x) > lag)
        acf = num / n / norm
        if truncate and lag and acf <= 0:
            break
        total += (0.5 if lag == 0 else 1.0) * acf * (1 - lag / longest)
    return 1.0 / (2 * total)


def vamp_score(k, c00, c0t, ctt, c00_test, c0t_test, ctt_test, rank: int | None = None, score: str = "VAMP2") -> float:
    """VAMP-1, VAMP-2 or VAMP-E score of a Koopman matrix on test moments."""
    u0, ut = spd_inv_sqrt(c00), spd_inv_sqrt(ctt)
    u, s, vt = np.linalg.svd(u0 @ c0t @ ut, full_matrices=False)
    m = min(rank or len(s), len(s))
    u, s, v = u0 @ u[:, :m], s[:m], ut @ vt[:m].T
    a, b, c = u.T @ c00_test @ u, u.T @ c0t_test @ v, v.T @ ctt_test @ v
    if score.upper() == "VAMPE":
        d = np.diag(s)
        return float(np.trace(2 * d @ b - d @ a @ d @ c))
    inner = spd_inv_sqrt(a) @ b @ spd_inv_sqrt(c)
    return float(np.linalg.norm(inner, "nuc") if score.upper() == "VAMP1" else np.linalg.norm(inner, "fro") ** 2)
