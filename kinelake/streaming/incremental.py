"""Incremental estimation on streams of frames: transition counts and lagged moments.

Two ways.  Micro-batch merging (``foreachBatch``) estimates each batch by itself and adds: pairs never cross
batches, as with repeated ``partial_fit``.  Keyed state keeps the last ``lag`` frames of every trajectory, so pairs
that cross batches count too; frames that are no longer needed leave the state, and a watermark or timeout can end
it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinelake.operators.dtrajs import transition_counts
from kinelake.operators.moments import Moments, moments_lagged


@dataclass
class CountMerger:
    """Counts summed over micro-batches; a batch that comes again after a restart is not added twice."""

    lag: int
    counts: dict[tuple[int, int], int] = field(default_factory=dict)
    done: set[int] = field(default_factory=set)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id in self.done:
            return
        for r in transition_counts(batch, self.lag).collect():  # a row for each pair of states
            self.counts[r.i, r.j] = self.counts.get((r.i, r.j), 0) + r.n
        self.done.add(batch_id)

    def matrix(self) -> np.ndarray:
        n = 1 + max((max(k) for k in self.counts), default=-1)
        out = np.zeros((n, n))
        for (i, j), v in self.counts.items():
            out[i, j] = v
        return out


@dataclass
class MomentMerger:
    """Lagged moments merged over micro-batches."""

    lag: int
    moments: Moments | None = None
    done: set[int] = field(default_factory=set)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id in self.done or batch.isEmpty():
            return
        m = moments_lagged(batch, self.lag)
        self.moments = m if self.moments is None else self.moments.combine(m)
        self.done.add(batch_id)


def run_available(stream: DataFrame, sink, checkpoint: str):
    """Feed a stream's available data to a merger and wait until it has been processed."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sink


def streaming_counts(stream: DataFrame, lag: int, idle: str | None = None) -> DataFrame:
    """``traj_id, i, j, n`` in update mode: transitions of each trajectory so far, pairs across batches included.

    The state of a trajectory is its last ``lag`` states and its counts.  Frames of a batch are ordered by ``t``; a
    frame at or before the last one seen is late and ignored.  With ``idle`` (milliseconds) a silent trajectory's state ends.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tail_t, tail_s, pairs, counts = state.get if state.exists else ([], [], [], [])
        total = dict(zip(zip(pairs[::2], pairs[1::2], strict=True), counts, strict=True))
        rows = pd.concat(list(batches)).sort_values("t")
        if tail_t:
            rows = rows[rows["t"] > tail_t[-1]]
        t = [*tail_t, *rows["t"].tolist()]
        s = [*tail_s, *rows["state"].tolist()]
        at = dict(zip(t, s, strict=True))
        changed = set()
        for u in rows["t"].tolist():
            i, j = at.get(u - lag, -1), at[u]
            if i >= 0 and j >= 0:
                total[i, j] = total.get((i, j), 0) + 1
                changed.add((i, j))
        keep = [k for k, u in enumerate(t) if u > t[-1] - lag] if t else []
        state.update(([t[k] for k in keep], [s[k] for k in keep], [int(x) for p in total for x in p], [int(v) for v in total.values()]))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame([(key[0], i, j, total[i, j]) for i, j in sorted(changed)], columns=["traj_id", "i", "j", "n"])

    kind = stream.schema["traj_id"].dataType.simpleString()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return stream.groupBy("traj_id").applyInPandasWithState(update, f"traj_id {kind}, i int, j int, n bigint", "t array<bigint>, s array<int>, p array<int>, c array<bigint>", "update", timeout)


def windowed_events(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Event-time windows over an event stream: number and value of each type, late events within the watermark."""
    from pyspark.sql import functions as F

    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "v")
