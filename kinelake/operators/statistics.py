"""Autocorrelation, histograms, densities and free energies as plain aggregations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.operators.lag import BLOCK, lagged


def acf(values: DataFrame, max_lag: int, normalize: bool = True, mean: float | None = None, subtract_mean: bool = True, block: int = BLOCK) -> DataFrame:
    """``lag, acf`` of a frame-wise value ``v``, pooled over trajectories and divided by the number of pairs."""
    if subtract_mean:
        m = F.lit(mean) if mean is not None else None
        if m is None:
            values = values.join(F.broadcast(values.agg(F.avg("v").alias("m")))).withColumn("v", F.col("v") - F.col("m")).drop("m")
        else:
            values = values.withColumn("v", F.col("v") - m)
    lags = list(range(1, max_lag + 1))
    wide = lagged(values.select("traj_id", "t", "v"), lags or [1], ["v"], block)
    pairs = [F.struct(F.lit(0).alias("lag"), (F.col("v") * F.col("v")).alias("p"))] + [F.struct(F.lit(k).alias("lag"), (F.col("v") * F.col(f"v_{k}")).alias("p")) for k in lags]
    sums = wide.select(F.explode(F.array(*pairs)).alias("s")).where("s.p IS NOT NULL").groupBy("s.lag").agg((F.sum("s.p") / F.count("*")).alias("acf"))
    if normalize:
        zero = sums.where("lag = 0").select(F.col("acf").alias("zero"))
        sums = sums.join(F.broadcast(zero)).select("lag", (F.col("acf") / F.col("zero")).alias("acf"))
    return sums


def bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin of a value in equal bins over ``lo..hi``; the largest value falls into the last one."""
    width = (hi - lo) / bins
    return F.when(hi > lo, F.least(F.floor((value - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")


def histogram(values: DataFrame, bins: int, column: str = "v", weight: str | None = None) -> DataFrame:
    """``bin, n``: every bin, empty ones too."""
    edges = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    n = F.sum(weight) if weight else F.count("*")
    got = values.join(F.broadcast(edges)).groupBy(bin_of(F.col(column), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(n.alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_features(frames: DataFrame, bins: int = 50) -> DataFrame:
    """``dim, bin, n, height``: a histogram of every feature, its height relative to the feature's fullest bin."""
    long = frames.select(F.posexplode("x").alias("dim", "v"))
    edges = long.groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    got = long.join(F.broadcast(edges), "dim").groupBy("dim", bin_of(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))
    return got.withColumn("height", F.col("n") / F.max("n").over(Window.partitionBy("dim")))


def histogram_2d(values: DataFrame, bins: int = 100, x: str = "x", y: str = "y", weight: str | None = None) -> DataFrame:
    """``bx, by, z`` of the non-empty bins."""
    e = values.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    z = F.sum(weight) if weight else F.count("*").cast("double")
    bx, by = bin_of(F.col(x), F.col("x0"), F.col("x1"), bins), bin_of(F.col(y), F.col("y0"), F.col("y1"), bins)
    return values.join(F.broadcast(e)).groupBy(bx.alias("bx"), by.alias("by")).agg(z.alias("z"))


def density(hist: DataFrame) -> DataFrame:
    total = hist.agg(F.sum("z").alias("total"))
    return hist.join(F.broadcast(total)).withColumn("z", F.col("z") / F.col("total")).drop("total")


def free_energy(hist: DataFrame, min_zero: bool = False, kt: float = 1.0) -> DataFrame:
    """``z`` becomes ``-kT ln p``; empty bins are infinite; the least energy can be moved to 0."""
    f = density(hist).withColumn("f", F.when(F.col("z") > 0, -kt * F.log("z")).otherwise(float("inf"))).drop("z")
    if min_zero:
        low = f.agg(F.min("f").alias("low"))
        f = f.join(F.broadcast(low)).withColumn("f", F.col("f") - F.col("low")).drop("low")
    return f


def fill_empty(hist: DataFrame) -> DataFrame:
    """Bins of count 0 raised to the smallest count that is not 0."""
    low = hist.where("z > 0").agg(F.min("z").alias("low"))
    return hist.join(F.broadcast(low)).withColumn("z", F.greatest("z", "low")).drop("low")


def histogram_nd(frames: DataFrame, dimensions: Sequence[int], bins: Sequence[int]) -> DataFrame:
    """``cell array<int>, n``: equal bins between the extremes of the chosen dimensions."""
    cols = [F.get("x", F.lit(d)) for d in dimensions]
    e = frames.agg(*[F.min(c).alias(f"lo{k}") for k, c in enumerate(cols)], *[F.max(c).alias(f"hi{k}") for k, c in enumerate(cols)])
    cell = F.array(*[bin_of(c, F.col(f"lo{k}"), F.col(f"hi{k}"), b) for k, (c, b) in enumerate(zip(cols, bins, strict=True))])
    return frames.join(F.broadcast(e)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


def grid_means(values: DataFrame, bins: int = 100) -> DataFrame:
    """``bx, by, z``: the mean of ``z`` in every cell that has data."""
    e = values.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    bx, by = bin_of(F.col("x"), F.col("x0"), F.col("x1"), bins), bin_of(F.col("y"), F.col("y0"), F.col("y1"), bins)
    return values.join(F.broadcast(e)).groupBy(bx.alias("bx"), by.alias("by")).agg(F.avg("z").alias("z"))


def grid_nearest(values: DataFrame, bins: int = 100) -> np.ndarray:
    """``z`` on a ``bins`` x ``bins`` grid over the extremes of ``x`` and ``y`` by the nearest data point.

    Each point competes for the four nodes around it, in one aggregation of at most ``bins`` squared rows; a node with no
    point in its neighbouring cells takes the nearest of the points that won elsewhere.
    """
    lo_x, hi_x, lo_y, hi_y = values.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    sx, sy = ((hi - lo) / (bins - 1) or 1.0 for lo, hi in ((lo_x, hi_x), (lo_y, hi_y)))
    u, v = (F.col("x") - lo_x) / sx, (F.col("y") - lo_y) / sy
    nodes = F.array(*[F.struct(f(u).cast("int").alias("i"), g(v).cast("int").alias("j")) for f in (F.floor, F.ceil) for g in (F.floor, F.ceil)])
    rows = values.select("x", "y", "z", F.explode(F.array_distinct(nodes)).alias("n"))
    d = (F.col("x") - (F.col("n.i") * sx + lo_x)) ** 2 + (F.col("y") - (F.col("n.j") * sy + lo_y)) ** 2
    best = rows.groupBy("n.i", "n.j").agg(F.min(F.struct(d.alias("d"), "x", "y", "z")).alias("b")).select("i", "j", "b.x", "b.y", "b.z").collect()
    out = np.full((bins, bins), np.nan)
    for r in best:
        out[r.i, r.j] = r.z
    pts = np.array([(r.x, r.y) for r in best])
    z = np.array([r.z for r in best])
    for i, j in np.argwhere(np.isnan(out)):
        at = np.array([lo_x + i * sx, lo_y + j * sy])
        out[i, j] = z[((pts - at) ** 2).sum(1).argmin()]
    return out


def logsumexp(values: DataFrame, by: Sequence[str], column: str = "v") -> DataFrame:
    """``by..., lse`` by groups, shifted by each group's largest value."""
    top = values.groupBy(*by).agg(F.max(column).alias("top"))
    shift = F.when(F.abs(F.col("top")) < float("inf"), F.col("top")).otherwise(0.0)
    return values.join(top, list(by)).groupBy(*by).agg((F.max(shift) + F.log(F.sum(F.exp(F.col(column) - shift)))).alias("lse"))


def sample_statistics(samples: DataFrame, by: Sequence[str], column: str = "p", conf: float = 0.95) -> DataFrame:
    """Mean, population deviation and an interval at ``conf`` over posterior samples."""
    q = [(1 - conf) / 2, 1 - (1 - conf) / 2]
    return samples.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.percentile(column, q[0]).alias("lo"), F.percentile(column, q[1]).alias("hi"))


def statistical_inefficiency(values: DataFrame, max_lag: int, truncate: bool = True, mean_free: bool = False) -> float:
    """``1 / (2 tau)`` of a frame-wise value from its pooled autocorrelation up to ``max_lag``."""
    rows = dict(acf(values, max_lag, normalize=False).collect())  # max_lag + 1 rows
    longest, raw = values.groupBy("traj_id").agg(F.count("*").alias("n"), F.sum(F.col("v") ** 2).alias("s")).agg(F.max("n"), F.sum("s") / F.sum("n")).first()
    norm = rows[0] if mean_free else raw
    a = np.array([rows.get(k, 0.0) for k in range(max_lag + 1)]) / norm
    if truncate and (stop := np.flatnonzero(a[1:] <= 0)).size:
        a = a[: stop[0] + 1]
    w = 1 - np.arange(len(a)) / longest
    return float(1 / (2 * (0.5 * a[0] + (a[1:] * w[1:]).sum())))
