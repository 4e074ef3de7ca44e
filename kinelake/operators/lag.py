"""The time-lagged self-join: a frame and the frame ``lag`` steps on, inside a trajectory.

A window over a whole trajectory would put a long one into a single task.  Frames are therefore dealt by
(trajectory, block of ``block`` frames); the first ``lag`` frames of a block are also copied to the block before it,
so every pair lies inside one block.  That costs one shuffle and ``lag / block`` extra rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 65536


def blocked(df: DataFrame, reach: int, block: int = BLOCK, keys: Sequence[str] = ("traj_id",)) -> DataFrame:
    """``df`` with ``block``; rows that begin a block appear in the blocks before it too, as far as ``reach`` goes."""
    block = max(block, reach)
    b = F.floor(F.col("t") / block)
    copied = (F.col("t") % block < reach) & (b > 0)
    return df.withColumn("block", F.explode(F.when(copied, F.array(b, b - 1)).otherwise(F.array(b)))).withColumn("own", F.col("block") == b)


def lagged(df: DataFrame, lags: int | Sequence[int], columns: Sequence[str], block: int = BLOCK, keys: Sequence[str] = ("traj_id",)) -> DataFrame:
    """``df`` with ``<column>_<lag>`` for every lag (null beyond the end), all lags in one pass."""
    lags = [lags] if isinstance(lags, int) else list(lags)
    w = Window.partitionBy(*keys, "block").orderBy("t")
    wide = blocked(df, max(lags), block, keys)
    out = [F.lead(c, lag).over(w).alias(f"{c}_{lag}") for c in columns for lag in lags]
    return wide.select("*", *out).where("own").drop("block", "own")


def lagged_pairs(df: DataFrame, lag: int, column: str = "x", stride: int = 1, skip: int = 0, block: int = BLOCK) -> DataFrame:
    """``traj_id, t, x, y``: pairs from frames ``skip, skip + stride, ...``; the lag counts frames before striding."""
    other = f"{column}_{lag}"
    rows = lagged(df, lag, [column], block).where(F.col(other).isNotNull() & (F.col("t") >= skip) & ((F.col("t") - skip) % stride == 0))
    return rows.withColumnRenamed(other, "y").withColumnRenamed(column, "x")


def gapped_pairs(df: DataFrame, lag: int, column: str = "x") -> DataFrame:
    """Pairs ``t, t + lag`` by equality, for trajectories whose ``t`` has gaps."""
    later = df.select("traj_id", (F.col("t") - lag).alias("t"), F.col(column).alias("y"))
    return df.join(later, ["traj_id", "t"])


def long_enough(lengths: DataFrame, lag: int, skip: int = 0) -> DataFrame:
    """Trajectories that give at least one pair; raises if there is none."""
    ok = lengths.where(F.col("length") > lag + skip)
    if ok.isEmpty():
        raise ValueError(f"no trajectory is longer than lag + skip = {lag + skip}")
    return ok
