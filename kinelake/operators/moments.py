"""Weighted and lagged second moments by partial aggregation.

Every task folds its Arrow batches into one set of sums (``w, sum x, sum y, X'X, X'Y, Y'Y``) by matrix products, centred on
a shift for accuracy; the partial sums, a row for each task, meet in a tree of merges of ``FAN`` rows, so the driver
receives a single row whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.operators.base import Estimator
from kinelake.operators.lag import BLOCK, lagged_pairs

FAN = 64
ROW = "w double, sx array<double>, sy array<double>, xx array<double>, xy array<double>, yy array<double>"


@dataclass
class Moments:
    """Mergeable sums: weight, means' sums and mean-free products."""

    w: float
    sx: np.ndarray
    sy: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray

    def combine(self, other: Moments) -> Moments:
        """Pairwise update of mean-free products."""
        if not self.w:
            return other
        if not other.w:
            return self
        w = self.w + other.w
        dx, dy = self.sx / self.w - other.sx / other.w, self.sy / self.w - other.sy / other.w
        f = self.w * other.w / w
        return Moments(w, self.sx + other.sx, self.sy + other.sy, self.xx + other.xx + f * np.outer(dx, dx), self.xy + other.xy + f * np.outer(dx, dy), self.yy + other.yy + f * np.outer(dy, dy))

    @property
    def mean_x(self) -> np.ndarray:
        return self.sx / self.w

    @property
    def mean_y(self) -> np.ndarray:
        return self.sy / self.w

    def raw(self) -> Moments:
        """Products about the origin instead of the means."""
        return self.about(np.zeros_like(self.sx), np.zeros_like(self.sy))

    def about(self, mx: np.ndarray, my: np.ndarray) -> Moments:
        """Products about given constants."""
        dx, dy = self.mean_x - mx, self.mean_y - my
        return replace(self, xx=self.xx + self.w * np.outer(dx, dx), xy=self.xy + self.w * np.outer(dx, dy), yy=self.yy + self.w * np.outer(dy, dy))

    def symmetrized(self) -> Moments:
        """Forward and backward pairs together: weight 2 w, both sides with the joint sums, about the joint mean."""
        r = self.raw()
        s, xx, xy, w = r.sx + r.sy, r.xx + r.yy, r.xy + r.xy.T, 2 * r.w
        m = s / w
        xx, xy = xx - w * np.outer(m, m), xy - w * np.outer(m, m)
        return Moments(w, s, s, xx, xy, xx)


def empty(d: int, e: int | None = None) -> Moments:
    e = d if e is None else e
    return Moments(0.0, np.zeros(d), np.zeros(e), np.zeros((d, d)), np.zeros((d, e)), np.zeros((e, e)))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def batch_moments(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Moments:
    """Moments of one block of rows."""
    total = float(len(x)) if w is None else float(w.sum())
    if not len(x) or total == 0:
        return empty(x.shape[1], y.shape[1])
    sx, sy = (x.sum(0), y.sum(0)) if w is None else (w @ x, w @ y)
    cx, cy = x - sx / total, y - sy / total
    wx, wy = (cx, cy) if w is None else (cx * w[:, None], cy * w[:, None])
    return Moments(total, sx, sy, wx.T @ cx, wx.T @ cy, wy.T @ cy)


_PARTS = ("sx", "sy", "xx", "xy", "yy")


def _row(m: Moments) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(np.array([0, a.size], np.int32), pa.array(np.ascontiguousarray(a, float).ravel())) for a in (getattr(m, k) for k in _PARTS)]
    return pa.RecordBatch.from_arrays([pa.array([m.w]), *lists], names=["w", *_PARTS])


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[Moments]:
    """The moments of each row, read from Arrow's buffers."""
    for one in batch.to_batches() if isinstance(batch, pa.Table) else [batch]:
        for i in range(one.num_rows):
            sx, sy, xx, xy, yy = (one.column(k)[i].values.to_numpy() for k in _PARTS)
            d, e = len(sx), len(sy)
            yield Moments(one.column("w")[i].as_py(), sx, sy, xx.reshape(d, d), xy.reshape(d, e), yy.reshape(e, e))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            w = np.asarray(batch.column(2), float) if batch.num_columns > 2 else None
            m = batch_moments(_matrix(batch.column(0)), _matrix(batch.column(1)), w)
            total = m if total is None else total.combine(m)
    if total is not None:
        yield _row(total)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for m in _rows(batch):
            total = m if total is None else total.combine(m)
    if total is not None:
        yield _row(total)


def pair_moments(pairs: DataFrame, x: str = "x", y: str = "y", weight: str | None = None) -> Moments:
    """Moments of a DataFrame of row vectors ``x`` and ``y``."""
    rows = pairs.select(x, y, *([weight] if weight else [])).mapInArrow(_fold, ROW)
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while n > 1:
        n = -(-n // FAN)
        rows = rows.repartition(n).mapInArrow(_merge, ROW)
    out = None
    for m in _rows(rows.toArrow()):
        out = m if out is None else out.combine(m)
    if out is None:
        raise ValueError("there are no rows to take moments of")
    return out


def moments_xx(frames: DataFrame, weight: str | None = None) -> Moments:
    """Moments of ``x`` alone: the other side is empty while the frames are folded."""
    m = pair_moments(frames.withColumn("y", F.array().cast("array<double>")), weight=weight)
    return Moments(m.w, m.sx, m.sx, m.xx, m.xx, m.xx)


def moments_lagged(frames: DataFrame, lag: int, symmetrize: bool = False, stride: int = 1, skip: int = 0, weight: str | None = None, block: int = BLOCK) -> Moments:
    """Moments of the pairs ``t, t + lag``; the weight is the first frame's."""
    m = pair_moments(lagged_pairs(frames, lag, stride=stride, skip=skip, block=block), weight=weight) if lag else moments_xx(frames, weight)
    return m.symmetrized() if symmetrize else m


@dataclass
class LaggedCovariance(Estimator):
    """C00, C0t, Ctt and means of frames and their lagged partners.

    ``remove`` is ``"none"``, ``"data"`` (the sample means) or an array (a constant mean); ``reversible`` symmetrises;
    ``bessel`` divides by the weight less one.
    """

    lag: int = 0
    reversible: bool = False
    bessel: bool = True
    remove: str | np.ndarray = "none"
    stride: int = 1
    skip: int = 0
    weight: str | None = None
    columns: list[int] | None = None
    diag_only: bool = False
    moments: Moments | None = None

    def fit(self, frames: DataFrame) -> LaggedCovariance:
        self.moments = None
        return self.partial_fit(frames)

    def partial_fit(self, frames: DataFrame) -> LaggedCovariance:
        """Merge another set of frames; pairs never cross calls."""
        m = moments_lagged(frames, self.lag, False, self.stride, self.skip, self.weight)
        self.moments = m if self.moments is None else self.moments.combine(m)
        return self

    def _centred(self) -> Moments:
        if self.moments is None:
            raise ValueError("not fitted")
        m = self.moments
        if isinstance(self.remove, str):
            if self.reversible:
                m = m.symmetrized()
            return m.raw() if self.remove == "none" else m
        mean = np.asarray(self.remove, float)
        r = m.about(mean, mean)
        if self.reversible:
            r = replace(r, w=2 * r.w, xx=r.xx + r.yy, xy=r.xy + r.xy.T, yy=r.xx + r.yy)
        return r

    def _scaled(self, a: np.ndarray, w: float) -> np.ndarray:
        out = a / (w - 1 if self.bessel else w)
        if self.columns is not None:
            out = out[:, self.columns]
        return np.diag(out).copy() if self.diag_only else out

    @property
    def mean(self) -> np.ndarray:
        return (self.moments.symmetrized() if self.reversible else self.moments).mean_x

    @property
    def mean_tau(self) -> np.ndarray:
        return (self.moments.symmetrized() if self.reversible else self.moments).mean_y

    @property
    def c00(self) -> np.ndarray:
        m = self._centred()
        return self._scaled(m.xx, m.w)

    @property
    def c0t(self) -> np.ndarray:
        m = self._centred()
        return self._scaled(m.xy, m.w)

    @property
    def ctt(self) -> np.ndarray:
        m = self._centred()
        return self._scaled(m.yy, m.w)

    @property
    def n(self) -> float:
        return self.moments.w


def covar(frames: DataFrame, remove_mean: bool = False, weight: str | None = None) -> np.ndarray:
    m = moments_xx(frames, weight)
    m = m if remove_mean else m.raw()
    return m.xx / m.w


def covars(pairs: DataFrame, remove_mean: bool = False, symmetrize: bool = False, weight: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    m = pair_moments(pairs, weight=weight)
    m = m.symmetrized() if symmetrize else m
    m = m if remove_mean else m.raw()
    return m.xx / m.w, m.xy / m.w


def variable_columns(frames: DataFrame, tol: float = 0.0) -> list[int]:
    """Columns that are not constant."""
    d = frames.select(F.max(F.size("x"))).first()[0]
    r = frames.agg(*[F.max(F.get("x", F.lit(i))) - F.min(F.get("x", F.lit(i))) for i in range(d)]).first()
    return [i for i in range(d) if r[i] > tol]
