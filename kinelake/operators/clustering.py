"""Clustering of frames: assignment to centres, k-means, mini-batch k-means, regular space, uniform time.

Centres are a driver-side array whose size is checked before it travels with the tasks; every pass over the frames
is one Arrow map and, for k-means, one aggregation of ``k`` partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.operators.base import Estimator
from kinelake.operators.moments import _matrix
from kinelake.sources.frames import linear, strided

#: Bytes of centres that may travel with every task.
CENTER_BYTES = 256 << 20
#: Rounds of k-means|| seeding.
ROUNDS = 5


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    d = (x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)
    return np.maximum(d, 0)


def min_rmsd(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Root mean square deviation after optimal superposition, of rows of 3N coordinates."""
    a = x.reshape(len(x), -1, 3)
    b = centers.reshape(len(centers), -1, 3)
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    h = np.einsum("fni,cnj->fcij", a, b)
    u, s, vt = np.linalg.svd(h)
    s[..., 2] *= np.sign(np.linalg.det(u) * np.linalg.det(vt))
    total = (a**2).sum((1, 2))[:, None] + (b**2).sum((1, 2))
    return np.sqrt(np.maximum(total - 2 * s.sum(-1), 0) / a.shape[1])


def distances(x: np.ndarray, centers: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "minRMSD":
        return min_rmsd(x, centers)
    if metric != "euclidean":
        raise ValueError(f"unknown metric {metric}")
    return np.sqrt(squared_distances(x, centers))


def _nearest(x: np.ndarray, centers: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre (ties: the lower index) and its distance, in slices that bound the memory."""
    step = max(1, (4 << 20) // max(1, len(centers)))
    idx, dist = np.empty(len(x), np.int32), np.empty(len(x))
    for at in range(0, len(x), step):
        d = distances(x[at : at + step], centers, metric)
        idx[at : at + step] = d.argmin(1)
        dist[at : at + step] = d.min(1)
    return idx, dist


def _shared(frames: DataFrame, centers: np.ndarray):
    centers = np.asarray(centers, float)
    if centers.nbytes > CENTER_BYTES:
        raise ValueError(f"{centers.nbytes} bytes of centres are too many to send to every task")
    return frames.sparkSession.sparkContext.broadcast(centers)


def assign(frames: DataFrame, centers: np.ndarray, metric: str = "euclidean", stride: int = 1, skip: int = 0) -> DataFrame:
    """``traj_id, t, state, distance``: the nearest centre of each frame; equal distances go to the lower index."""
    centers = np.atleast_2d(np.asarray(centers, float))
    c = _shared(frames, centers)
    rows = strided(frames, stride, skip).select("traj_id", "t", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2))
                if x.shape[1] != c.value.shape[1]:
                    raise ValueError(f"frames have {x.shape[1]} dimensions, centres {c.value.shape[1]}")
                i, d = _nearest(x, c.value, metric)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(i), pa.array(d)], names=["traj_id", "t", "state", "distance"])

    kind = frames.schema["traj_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"traj_id {kind}, t bigint, state int, distance double")


def assign_sql(frames: DataFrame, centers: np.ndarray) -> DataFrame:
    """The same by column expressions only, for a few centres: a literal array of structs and its least element."""
    c = F.array(*[F.struct(F.lit(i).alias("c"), F.array(*[F.lit(float(v)) for v in row]).alias("p")) for i, row in enumerate(np.atleast_2d(centers))])
    d = lambda p: F.aggregate(F.zip_with("x", p, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.transform(c, lambda e: F.struct(d(e["p"]).alias("d"), e["c"].alias("c"))))
    return frames.select("traj_id", "t", best.alias("b")).select("traj_id", "t", F.col("b.c").alias("state"), F.sqrt("b.d").alias("distance"))


def _partial_sums(frames: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Per-centre counts and sums of its frames, and the total cost: one pass, ``k`` rows from each task."""
    c = _shared(frames, centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, cost = np.zeros(len(c.value)), np.zeros_like(c.value), np.zeros(len(c.value))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                i, d = _nearest(x, c.value, "euclidean")
                n += np.bincount(i, minlength=len(n))
                cost += np.bincount(i, d**2, minlength=len(n))
                np.add.at(s, i, x)
        used = np.flatnonzero(n)
        ends = np.arange(len(used) + 1, dtype=np.int32) * s.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(cost[used]), pa.ListArray.from_arrays(ends, pa.array(s[used].ravel()))], names=["c", "n", "cost", "s"])

    d = centers.shape[1]
    parts = frames.select("x").mapInArrow(run, "c int, n double, cost double, s array<double>")
    sums = parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.get("s", F.lit(k))) for k in range(d)]).alias("s"))
    n, s, cost = np.zeros(len(centers)), np.zeros_like(centers), 0.0
    for r in sums.collect():  # a row for each centre
        n[r.c], s[r.c] = r.n, r.s
        cost += r.cost
    return n, s, cost


def _drawn(frames: DataFrame, centers: np.ndarray, share: float, seed: int) -> np.ndarray:
    """Frames drawn independently, each with probability ``share`` times its squared distance from ``centers``."""
    c = _shared(frames, centers)
    draw = F.pmod(F.xxhash64(F.lit(seed), "traj_id", "t"), F.lit(1 << 52)) / F.lit(float(1 << 52))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, d = _nearest(_matrix(batch.column(1)), c.value, "euclidean")
                yield batch.filter(pa.array(np.asarray(batch.column(0)) < share * d**2)).select(["x"])

    rows = frames.select(draw.alias("u"), F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "x array<double>")
    return np.array([r.x for r in rows.collect()], float).reshape(-1, centers.shape[1])  # 2 k of them are expected


def seed_centers(frames: DataFrame, k: int, strategy: str = "kmeans++", seed: int = 0) -> np.ndarray:
    """Initial centres: uniform frames, or k-means|| over all frames.

    Each of ``ROUNDS`` rounds draws about ``2 k`` frames by their squared distance from the candidates so far; the candidates,
    weighted by the frames nearest to them, are reclustered by k-means++ on the driver.
    """
    key = F.xxhash64(F.lit(seed), "traj_id", "t")
    first = np.array([r[0] for r in frames.orderBy(key, "traj_id", "t").limit(k).select("x").collect()], float)
    if len(first) < k:
        raise ValueError(f"{k} centres need at least as many frames, there are {len(first)}")
    if strategy == "uniform":
        return first
    x = first[:1]
    for it in range(ROUNDS):
        cost = _partial_sums(frames, x)[2]
        if cost <= 0:
            break
        x = np.unique(np.concatenate([x, _drawn(frames, x, 2 * k / cost, seed + 1 + it)]), axis=0)
    if len(x) < k:
        x = np.concatenate([x, first])
    n = _partial_sums(frames, x)[0]
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(x), p=n / n.sum()))]
    d = squared_distances(x, x[chosen])[:, 0]
    d[chosen] = 0
    for _ in range(1, k):
        p = n * d
        p = p / p.sum() if p.sum() > 0 else np.full(len(x), 1 / len(x))
        chosen.append(int(rng.choice(len(x), p=p)))
        d = np.minimum(d, squared_distances(x, x[chosen[-1:]])[:, 0])
        d[chosen] = 0
    return x[chosen]


@dataclass
class KMeans(Estimator):
    """Lloyd's algorithm: one pass and ``k`` sums for each iteration; resumes from given centres."""

    k: int | None = None
    max_iter: int = 10
    tolerance: float = 1e-5
    init: str = "kmeans++"
    seed: int = 0
    stride: int = 1
    skip: int = 0
    centers: np.ndarray | None = None
    converged: bool = False
    cost: float = np.inf

    def fit(self, frames: DataFrame) -> KMeans:
        frames = strided(frames, self.stride, self.skip)
        if self.centers is None:
            if self.k is None:
                self.k = int(min(np.sqrt(frames.count()), 5000))
            self.centers = seed_centers(frames, self.k, self.init, self.seed)
        self.k = len(self.centers)
        self.converged = False
        for _ in range(self.max_iter):
            n, s, cost = _partial_sums(frames, self.centers)
            used = n > 0
            self.centers = np.where(used[:, None], s / np.maximum(n, 1)[:, None], self.centers)
            change, self.cost = abs(self.cost - cost), cost
            if change <= self.tolerance * max(cost, 1e-300):
                self.converged = True
                break
        return self

    def transform(self, frames: DataFrame) -> DataFrame:
        return assign(frames, self.centers)


@dataclass
class MiniBatchKMeans(Estimator):
    """k-means on a share of each trajectory's frames, drawn anew without replacement for each iteration."""

    k: int = 100
    max_iter: int = 10
    batch_size: float = 0.2
    tolerance: float = 1e-5
    init: str = "kmeans++"
    seed: int = 0
    stride: int = 1
    skip: int = 0
    centers: np.ndarray | None = None
    converged: bool = False

    def fit(self, frames: DataFrame) -> MiniBatchKMeans:
        frames = strided(frames, self.stride, self.skip)
        if self.centers is None:
            self.centers = seed_centers(frames, self.k, self.init, self.seed)
        weight = np.zeros(len(self.centers))
        last = np.inf
        for it in range(self.max_iter):
            draw = F.pmod(F.xxhash64(F.lit(self.seed + 1), F.lit(it), "traj_id", "t"), F.lit(1 << 30)) < int(self.batch_size * (1 << 30))
            n, s, cost = _partial_sums(frames.where(draw), self.centers)
            weight += n
            used = n > 0
            rate = np.where(used, n / np.maximum(weight, 1), 0)[:, None]
            self.centers = (1 - rate) * self.centers + rate * np.where(used[:, None], s / np.maximum(n, 1)[:, None], self.centers)
            cost /= max(1.0, n.sum())
            if abs(last - cost) <= self.tolerance * cost:
                self.converged = True
                break
            last = cost
        return self

    def transform(self, frames: DataFrame) -> DataFrame:
        return assign(frames, self.centers)


@dataclass
class RegularSpace(Estimator):
    """Centres at least ``dmin`` apart such that every frame is within ``dmin`` of one.

    Every task keeps the frames that none of its earlier ones covers; the survivors, at most ``max_centers`` from a
    task, are passed in ``(traj_id, t)`` order to the same rule again, in merges of ``FAN`` tasks.  With one task that is
    the sequential rule itself.  Beyond ``max_centers`` the result is cut and ``truncated`` set.
    """

    dmin: float
    max_centers: int = 1000
    metric: str = "euclidean"
    stride: int = 1
    skip: int = 0
    centers: np.ndarray | None = None
    truncated: bool = False

    def fit(self, frames: DataFrame) -> RegularSpace:
        if self.dmin <= 0:
            raise ValueError("dmin must be positive")
        dmin, limit, metric = self.dmin, self.max_centers, self.metric

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chosen: list[np.ndarray] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(2))
                free = np.flatnonzero(_nearest(x, np.array(chosen), metric)[1] > dmin) if chosen else np.arange(len(x))
                taken = []
                fresh: list[np.ndarray] = []
                for i in free.tolist():
                    if len(chosen) > limit:
                        break
                    if not fresh or distances(x[i : i + 1], np.array(fresh), metric).min() > dmin:
                        fresh.append(x[i])
                        chosen.append(x[i])
                        taken.append(i)
                yield batch.take(pa.array(taken, pa.int64()))

        rows = strided(frames, self.stride, self.skip).select("traj_id", "t", "x")
        shape = f"traj_id {frames.schema['traj_id'].dataType.simpleString()}, t bigint, x array<double>"
        parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.mapInArrow(keep, shape)
        while parts > 1:
            parts = -(-parts // 16)
            rows = rows.repartitionByRange(parts, "traj_id", "t").sortWithinPartitions("traj_id", "t").mapInArrow(keep, shape)
        got = np.array([r.x for r in rows.orderBy("traj_id", "t").limit(limit + 1).collect()])
        self.truncated = len(got) > limit
        self.centers = got[:limit]
        return self

    def transform(self, frames: DataFrame) -> DataFrame:
        return assign(frames, self.centers, self.metric)


@dataclass
class UniformTime(Estimator):
    """``k`` frames evenly spaced on the concatenated time axis."""

    k: int = 2
    metric: str = "euclidean"
    stride: int = 1
    skip: int = 0
    centers: np.ndarray | None = None

    def fit(self, frames: DataFrame) -> UniformTime:
        self.centers = np.array([r.x for r in uniform_time_frames(strided(frames, self.stride, self.skip), self.k).orderBy("c").collect()])
        return self

    def transform(self, frames: DataFrame) -> DataFrame:
        return assign(frames, self.centers, self.metric)


def uniform_time_frames(frames: DataFrame, k: int) -> DataFrame:
    """``c, traj_id, t, x``: the frames in the middles of ``k`` equal stretches."""
    numbered = linear(frames)
    total = frames.agg(F.count("*").alias("total"))
    want = total.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("c"), "total").select("c", F.floor((2 * F.col("c") + 1) * F.col("total") / (2 * k)).alias("pos"))
    return numbered.join(F.broadcast(want), "pos").select("c", "traj_id", "t", "x")


@dataclass
class AssignCenters(Estimator):
    """Assignment to centres given as an array, or as rows of a text or ``.npy`` file."""

    centers: np.ndarray | str
    metric: str = "euclidean"
    stride: int = 1
    skip: int = 0

    def __post_init__(self):
        if isinstance(self.centers, str):
            self.centers = np.load(self.centers, allow_pickle=False) if self.centers.endswith(".npy") else np.loadtxt(self.centers, ndmin=2)

    def fit(self, frames: DataFrame) -> AssignCenters:
        return self

    def transform(self, frames: DataFrame) -> DataFrame:
        return assign(frames, self.centers, self.metric, self.stride, self.skip)


def closest_frames(assigned: DataFrame) -> DataFrame:
    """``state, traj_id, t``: the frame nearest to each centre."""
    best = F.min(F.struct("distance", "traj_id", "t"))
    return assigned.groupBy("state").agg(best.alias("b")).select("state", "b.traj_id", "b.t")
